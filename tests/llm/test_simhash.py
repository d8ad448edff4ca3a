import random

import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """{doc_id: fp} -> {doc_id: smallest reachable doc_id}."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def result(df):
    return {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in df.collect()}


def test_matches_brute_force(spark):
    docs = table(spark, SF, "documents")
    got = result(simhash.near_duplicates(docs))
    fps = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
    want = brute_components(fps)
    assert got == {i: (fps[i], want[i]) for i in fps}
    assert len({c for _, c in got.values()}) < len(got)


def planted(rng, centres=12, around=40):
    fps = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(around):
            x = c
            for _ in range(rng.randrange(0, 9)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    return sorted(fps)


def components_of(spark, fps, hot):
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    roots = {r["node"] & (2**64 - 1): r["root"] for r in simhash.connected(simhash.links(nodes, hot)).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(roots.get(f, int(np.uint64(f).view(np.int64))), set()).add(f)
    return sorted(map(sorted, groups.values()))


def test_links_any_bucket_size(spark):
    fps = planted(random.Random(5))
    parts = brute_components(dict(zip(fps, fps)))
    want = {}
    for f, r in parts.items():
        want.setdefault(r, set()).add(f)
    want = sorted(map(sorted, want.values()))
    assert components_of(spark, fps, simhash.HOT_BUCKET) == want
    assert components_of(spark, fps, 3) == want  # all but the smallest buckets are dealt out again


def test_edge_cases(make_docs):
    rows = [(5, None), (3, ""), (9, " \n"), (None, "a b c d"), (7, "A b C d"), (7, "A b C d"), (8, "one"), (2, "x " * 70_000)]
    found = simhash.near_duplicates(make_docs(rows)).collect()
    assert len(found) == len(rows)
    by = {(r["doc_id"]): r for r in found}
    assert by[5]["fp"] == by[3]["fp"] == by[9]["fp"] == 0 and by[5]["component_id"] == by[9]["component_id"] == 3
    assert by[None]["component_id"] == 7 and by[7]["component_id"] == 7
    assert by[8]["component_id"] == 8
    kept = simhash.drop_near_duplicates(make_docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 7, 8]
    assert kept.columns == make_docs(rows).columns
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert simhash.drop_near_duplicates(make_docs([])).count() == 0


def test_rows_without_an_id_or_with_one_id_stay_apart(make_docs):
    """Components without any id, and unrelated texts of one id, are groups of their own."""
    rows = [(None, "one two three four"), (None, "five six seven eight"), (None, "five six seven eight"), (6, "nine ten eleven twelve"), (6, "red green blue white"), (6, "red green blue white"), (8, "nine ten eleven twelve")]
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(make_docs(rows)).collect()), key=str)
    assert kept == sorted([(None, "one two three four"), (None, "five six seven eight"), (6, "nine ten eleven twelve"), (6, "red green blue white")], key=str)


def test_connected_across_tasks(spark, monkeypatch):
    """Chains that no task holds whole, repeated edges, negative nodes; with pieces of a few edges as well."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(-40, 60)] + [(1000 + i, 1000) for i in range(50)] * 2
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    edges = [(a, b) for a, b in edges if a != b]
    rng.shuffle(edges)
    low = {n: n for e in edges for n in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    want = {n: r for n, r in low.items() if n != r}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    for held in (simhash.HELD_EDGES, 1):
        monkeypatch.setattr(simhash, "HELD_EDGES", held)
        assert {r["node"]: r["root"] for r in simhash.connected(df).collect()} == want
    assert simhash.connected(df.limit(0)).count() == 0
