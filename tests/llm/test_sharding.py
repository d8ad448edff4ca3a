import zlib
from collections import defaultdict

from tidemark.llm import sharding
from tidemark.llm.common import table


def check(rows, given, shards):
    texts = sorted(given, key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts), key=str)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sizes.values()) / shards, max((r["size"] for r in rows), default=0)
    assert all(abs(sizes[s] - mean) <= largest for s in range(shards))


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    first = sharding.shard(docs).collect()
    check(first, given, 40)
    again = sharding.shard(docs.repartition(7)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_hot_and_odd_rows(make_docs):
    rows = [(i, "the same text") for i in range(3000)] + [(None, None), (None, "n"), (5, ""), (9, "é" * 40_000)] + [(77, "repeated")] * 500
    check(sharding.shard(make_docs(rows), 7, samples_a_range=4).collect(), rows, 7)
    assert sharding.shard(make_docs([])).count() == 0


def brute(rows, shards):
    """Shards and slots by a plain loop: rows in the order of the hash of their text and their id, cut by the bytes before them."""
    order = sorted(rows, key=lambda r: (r["k"], r["doc_id"] is not None, r["doc_id"] or 0))
    total, at, slots, out = sum(r["size"] for r in order), 0, defaultdict(int), []
    for r in order:
        s = min(shards - 1, at * shards // max(1, total))
        out.append((r["doc_id"], r["size"], r["text_crc32"], s, slots[s]))
        slots[s] += 1
        at += r["size"]
    return sorted(out, key=str)


def test_placement_matches_brute_force(spark, make_docs):
    """Every record's shard and slot, with half of the rows one text without an id."""
    real = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    docs = make_docs(real + [(None, "hot row")] * len(real) + [(5, "é" * 30_000), (6, None)])
    want = brute(sharding.records(docs).collect(), 40)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(docs).collect()), key=str) == want


def test_repeated_rows_are_cut_apart(make_docs, monkeypatch):
    """Rows that are equal in all columns spread over many ranges."""
    found = {}
    monkeypatch.setattr(sharding, "range_of", lambda bounds, f=sharding.range_of: found.update(n=len(bounds)) or f(bounds))
    rows = [(None, "hot row")] * 2000 + [(i, f"t{i}") for i in range(200)]
    check(sharding.shard(make_docs(rows), 5).collect(), rows, 5)
    assert found["n"] > 100


def test_overfull_ranges_are_subdivided(make_docs, monkeypatch):
    monkeypatch.setattr(sharding, "splitters", lambda keys, n, f=sharding.splitters: f(keys, min(n, 3)))
    rows = [(i, f"t{i}") for i in range(800)]
    check(sharding.shard(make_docs(rows), 5).collect(), rows, 5)


def test_each_overfull_range_is_cut_by_its_own_keys():
    key = lambda k: (k, 0, 0)
    bounds = [key(10), key(20), key(30)]
    drawn = sorted([key(10)] * 90 + [key(12), key(15)] + [key(20)] * 7 + [key(k) for k in range(30, 50)])
    cuts = sharding.subdivided(bounds, drawn, [1, 2, 3])
    assert cuts[1] == [key(15)]  # its first record takes all quantiles: the middle of the other keys
    assert 2 not in cuts  # nothing to cut at
    assert len(cuts[3]) == 4 and all(key(30) < k < key(50) for k in cuts[3])
    assert sharding.subdivided(bounds, [], [1]) == {} and sharding.subdivided([], [key(4)], [0]) == {0: [key(4)]}


def test_a_range_that_cannot_be_cut_keeps_no_other_from_it(make_docs, monkeypatch):
    """The range of a huge record draws that record alone; all others are still cut to their bound."""
    bounds = []
    monkeypatch.setattr(sharding, "splitters", lambda keys, n, f=sharding.splitters: f(keys, min(n, 4)))
    monkeypatch.setattr(sharding, "range_of", lambda found, f=sharding.range_of: bounds.append(found) or f(found))
    rows = [(-1, "x" * 200_000)] + [(i, f"text {i}") for i in range(1500)]
    docs = make_docs(rows)
    check(sharding.shard(docs, 5).collect(), rows, 5)
    held = defaultdict(list)
    for r in sharding.records(docs).withColumn("range", sharding.range_of(bounds[-1])).collect():
        held[r["range"]].append(r["size"])
    most = 2 * sum(map(sum, held.values())) // sharding.LEAST_RANGES
    assert max(sum(s) - max(s) for s in held.values()) <= most
