import random
from collections import Counter

from tidemark.llm import decontaminate as dc
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


def words_of(text):
    kept = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "" if ord(c) > 126 or ord(c) < 33 or c.isalnum())
    for c in "\t\n\r\x0b\x0c":
        kept = kept.replace(c, " ")
    return [w for w in kept.split(" ") if w]


def brute(text, item):
    """Best similarity of any window of the item's number of words."""
    w, q = words_of(text), words_of(item)
    size = min(5, len(q))
    if not q or len(w) < len(q):
        return 0.0
    grams = lambda x: Counter(tuple(x[i : i + size]) for i in range(len(x) - size + 1))
    want, best = grams(q), 0.0
    for i in range(len(w) - len(q) + 1):
        got = grams(w[i : i + len(q)])
        if want.keys() & got.keys():
            best = max(best, sum((want & got).values()) / sum((want | got).values()))
    return best


def test_matches_brute_force(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, items).collect()}
    want = {
        (d["doc_id"], b["item_id"]) for d in docs.collect() for b in items.collect() if brute(d["text"], b["text"]) >= 0.8
    }
    assert got == want and want
    left = {r["doc_id"] for r in dc.drop_contaminated(docs, items).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {d for d, _ in want}


def test_edited_passages(spark, make_docs):
    """Passages with an edited end, at each similarity from 0.8 up, are found; the radius loses none."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, items, want = [], [], set()
    for i in range(150):
        item = [word() for _ in range(rng.randrange(12, 70))]
        cut = rng.randrange(0, max(1, len(item) // 8))
        passage = item[: len(item) - cut] + [word() for _ in range(cut)]
        text = " ".join([word() for _ in range(rng.randrange(0, 200))] + passage + [word() for _ in range(rng.randrange(0, 200))])
        items.append((i, " ".join(item)))
        rows.append((i, text))
        if brute(text, items[-1][1]) >= 0.8:
            want.add((i, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated(make_docs(rows), bench).collect()} == want
    old, dc.ITEM_BYTES, dc.TEXT_WORDS = dc.ITEM_BYTES, 4500, 40
    try:  # several blocks of items in two passes, texts in several parts
        assert dc.BLOCKS_A_PASS < len(list(dc.item_blocks(bench))) < 2 * dc.BLOCKS_A_PASS + 9
        assert {(r["doc_id"], r["item_id"]) for r in dc.contaminated(make_docs(rows), bench).collect()} == want
        assert {r["doc_id"] for r in dc.drop_contaminated(make_docs(rows), bench).collect()} == set(range(150)) - {d for d, _ in want}
    finally:
        dc.ITEM_BYTES, dc.TEXT_WORDS = old, 1 << 18


def test_edge_cases(spark, make_docs):
    bench = spark.createDataFrame([(1, None), (2, " ,. "), (3, "alpha beta"), (4, "a b c d e f g"), (4, "a b c d e f g")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "x Alpha, beta y"), (None, "A b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "z " * 90_000)]
    got = sorted(((r["doc_id"] or -1), r["item_id"]) for r in dc.contaminated(make_docs(rows), bench).collect())
    assert got == [(-1, 4), (3, 3), (5, 4), (5, 4)]
    assert sorted(r["doc_id"] for r in dc.drop_contaminated(make_docs(rows), bench).collect()) == [1, 2, 6]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(make_docs(rows), empty).count() == 0 and dc.contaminated(make_docs([]), bench).count() == 0
    assert dc.drop_contaminated(make_docs(rows), empty).count() == len(rows)


def test_texts_shorter_than_an_item(spark, make_docs):
    """Items less some words at either end, with and without edits, as whole documents."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    grams = lambda x: Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
    rows, items, want = [], [], set()
    for i in range(120):
        item = [word() for _ in range(rng.randrange(6, 70))]
        front, back = rng.randrange(0, 1 + len(item) // 8), rng.randrange(1, 2 + len(item) // 8)
        text = item[front : len(item) - back]
        if i % 3 == 0:
            text[-1] = word()
        a, b = grams(text), grams(item)
        items.append((i, " ".join(item)))
        rows.append((i, " ".join(text)))
        if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
            want.add((i, i, len(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["n_words"]) for r in dc.contaminated(make_docs(rows), bench).collect()} == want
    assert 20 < len(want) < 100
    assert {r["doc_id"] for r in dc.drop_contaminated(make_docs(rows), bench).collect()} == set(range(120)) - {i for i, _, _ in want}
