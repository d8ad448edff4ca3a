import random

import numpy as np

from tidemark.llm import near_copies
from tidemark.llm.common import table


def shingles(text):
    w = (text or "").encode().lower().split()
    size = min(5, len(w))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else frozenset()


def brute(rows):
    """{doc_id: smallest doc_id that pairs of similarity >= 0.8 reach}."""
    sets, ids = {i: shingles(t) for i, t in rows}, sorted(i for i, _ in rows)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def planted():
    """Copies at similarities around 0.8, a large group of copies, and a line and an ending that many texts share."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    line, texts = [word() for _ in range(30)], []
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(4, 160))]
        texts += [edited(rng, base, rng.randrange(0, 4)) for _ in range(3)]
        texts += [base[: len(base) - rng.randrange(0, 1 + len(base) // 4)], base + [word() for _ in range(len(base) // 5)], line + base[:9]]
    hot = [word() for _ in range(90)]
    texts += [edited(rng, hot, rng.randrange(0, 3)) for _ in range(200)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_matches_brute_force(make_docs):
    rows = planted()
    want = brute(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(make_docs(rows)).collect()}
    assert got == want and len(set(want.values())) < len(rows)
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(make_docs(rows)).collect()) == sorted(set(want.values()))


def test_any_order_and_blocks(make_docs, monkeypatch):
    """Without common shingles and with the smallest blocks the links are the same."""
    rows = planted()[:250]
    monkeypatch.setattr(near_copies, "COMMON_TEXTS", 10**9)
    monkeypatch.setattr(near_copies, "HOT_PAIRS", 2)
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(make_docs(rows)).collect()} == brute(rows)


def test_large_buckets_meet_in_blocks(make_docs, monkeypatch):
    """Texts that share most of a line but are mostly no copies: a bucket of many blocks, and the same links."""
    rng = random.Random(5)
    line = [f"w{i}" for i in range(19)]
    texts = [line + [f"x{rng.randrange(12)}" for _ in range(5)] for _ in range(150)] + [line + [f"x{i % 7}", "y", "y", "y", "y"] for i in range(60)]
    rows = planted()[:60] + [(1000 + i, " ".join(t)) for i, t in enumerate(texts)]
    monkeypatch.setattr(near_copies, "COMMON_TEXTS", 10**9)
    monkeypatch.setattr(near_copies, "BLOCK_ROWS", 20)
    marked = near_copies.marked_texts(make_docs(rows))
    assert near_copies.large_buckets(near_copies.buckets(marked)).count() > 0
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(make_docs(rows)).collect()} == brute(rows)


def test_class_counts_bound_the_difference():
    """Never above the shingles of one set alone, whatever the sizes and however full a class; close to it for long unlike sets."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 4, 5, 40, 700, 9000):
        for m in (1, n, n + n // 5):
            for shared in (0, min(n, m) // 2, min(n, m)):
                every = rng.integers(0, 2**64, n + m - shared, dtype=np.uint64)
                for hashes in (every, np.arange(len(every), dtype=np.uint64) << np.uint64(40)):
                    a, b = np.sort(hashes[:n]), np.sort(hashes[n - shared :])
                    x, y = near_copies.class_counts(a), near_copies.class_counts(b)
                    assert len(x) & (len(x) - 1) == 0 and near_copies.least_apart(x, y) <= n + m - 2 * shared
    a, b = (np.sort(rng.integers(0, 2**64, 9000, dtype=np.uint64)) for _ in range(2))
    assert near_copies.least_apart(near_copies.class_counts(a), near_copies.class_counts(b)) > 4000


def test_unlike_long_texts_are_not_verified(spark, make_docs):
    """Of all pairs only those that may be similar reach the sets: every similar one, and none of the unlike long ones."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [base, edited(rng, base, 20), edited(rng, base, 60)] + [base[:100] + [f"w{rng.randrange(10**6)}" for _ in range(2900)] for _ in range(5)]
    marked = near_copies.staged(near_copies.marked_texts(make_docs([(i, " ".join(t)) for i, t in enumerate(texts)])), "marked")
    node = {r["doc_id"]: r["node"] for r in marked.collect()}
    every = [(min(node[i], node[j]), max(node[i], node[j])) for i in node for j in node if i < j]
    pairs = near_copies.staged(spark.createDataFrame(every, "a long, b long"), "pairs")
    got = {tuple(r) for r in near_copies.plausible(pairs, marked).collect()}
    near = {(min(node[i], node[j]), max(node[i], node[j])) for i in range(3) for j in range(i)}
    similar = {tuple(r) for r in near_copies.verified(pairs, marked, make_docs([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert similar <= got <= near and (min(node[0], node[1]), max(node[0], node[1])) in similar


def test_pieces_of_a_large_bucket():
    """Every row comes once, in order, and no piece of a large key holds another key."""
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(1).choice([1, 2, 2, 2, 2, 3, 4, 4, 9], 500))
    batches = [pa.record_batch([pa.array(keys[i : i + 7]), pa.array(np.arange(i, min(i + 7, 500)))], names=["key", "at"]) for i in range(0, 500, 7)]
    pieces = list(near_copies._partly(iter(batches), 40))
    assert np.concatenate([c[1] for c, _ in pieces]).tolist() == list(range(500))
    assert any(cut for _, cut in pieces) and all(len(set(c[0])) == 1 and len(c[0]) <= 48 for c, cut in pieces if cut)
    whole = [k for c, cut in pieces if not cut for k in set(c[0].tolist())]
    assert len(whole) == len(set(whole)) and not set(whole) & {int(c[0][0]) for c, cut in pieces if cut}


def test_pipeline_stage(spark):
    """The stage that had the links of op4 only."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.drop_exact_duplicates(spark, table(spark, sf, "documents"), sf)
    want = set(brute([(r["doc_id"], r["text"]) for r in docs.collect()]).values())
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()} == want


def test_edge_cases(make_docs):
    rows = [(5, None), (3, ""), (9, " \n"), (None, "a b c d"), (7, "A b C d"), (7, "A b C d"), (8, "one"), (2, "x " * 70_000)]
    kept = near_copies.drop_near_copies(make_docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 7, 8] and kept.columns == make_docs(rows).columns
    assert near_copies.drop_near_copies(make_docs([])).count() == 0


def test_meetings_match_all_pairs():
    """The pairs that a bucket proposes are those of all its pairs whose roots differ, each once."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        key, node, root = np.sort(rng.integers(0, 4, n)), rng.permutation(1000)[:n], rng.integers(0, 5, n)
        size, leads, sketch = rng.integers(0, 12, n).astype(np.int32), rng.random(n) < 0.7, [rng.integers(0, 4, n).astype(np.uint64)]

        def proposed(a, b):
            good = near_copies._may_be_similar(node, size, leads, sketch, a, b)
            return [frozenset(p) for p in zip(a[good].tolist(), b[good].tolist(), strict=True)]

        a, b = np.triu_indices(n, 1)
        apart = (key[a] == key[b]) & (root[a] != root[b])
        found = np.flatnonzero(near_copies._have_partners(key, node, size, leads))
        assert frozenset().union(*proposed(a[key[a] == key[b]], b[key[a] == key[b]])) <= set(found.tolist())
        got = [p for a_, b_ in near_copies._meetings(key, node, size, leads, root) for p in proposed(a_, b_)]
        assert len(got) == len(set(got)) and set(got) == set(proposed(a[apart], b[apart]))
