import numpy as np

from tidemark.llm import quality
from tidemark.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = {r["doc_id"]: r for r in quality.score_quality(docs, quality.fit(docs, labels)).collect()}
    assert len(scored) == docs.count()
    pairs = [(scored[r["doc_id"]]["score"] >= 0.3, r["quality"] == 1) for r in labels.collect() if scored[r["doc_id"]]["held_out"]]
    assert np.mean([p == t for p, t in pairs]) > 0.95


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.AdditiveModel(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


def test_edge_cases(spark, make_docs):
    rows = [(1, None), (2, ""), (None, "a b"), (5, "x"), (5, "x"), (6, "w " * 80_000)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(5, 1, 1), (None, 1, 0), (6, 0, None), (1, None, 0)], none.schema)
    for labels in (none, some):
        model = quality.fit(make_docs(rows), labels)
        got = quality.score_quality(make_docs(rows), model).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert quality.score_quality(make_docs([]), model).count() == 0


def plain_features(text):
    """The 18 features by plain loops over bytes, words and lines."""
    text = text or ""
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    count = lambda test: sum(1 for b in raw if test(chr(b), b))
    size, n = max(1, len(raw)), max(1, len(words))
    spaces, letters = count(lambda c, b: c in " \t\n\r\v\f"), count(lambda c, b: (b < 128 and c.isalpha()) or b >= 192)
    stops, marks = count(lambda c, b: c in ".,;:"), count(lambda c, b: c in "!?")
    often = {w: words.count(w) for w in set(words)}
    alone = sum(1 for w in words if len(w) == 1 and not w.isalnum())
    return [
        np.log(1 + len(words)), (size - spaces) / n, len(often) / n, max(often.values(), default=0) / n,
        sum(1 for a, b in zip(words, words[1:]) if a == b) / n, sum(1 for w in words if len(w) <= 3) / n,
        count(lambda c, b: "A" <= c <= "Z") / max(1, letters), count(lambda c, b: "0" <= c <= "9") / size, spaces / size, stops / size, marks / size,
        count(lambda c, b: 32 < b < 127 and not c.isalnum() and c not in ".,;:!?'\"-()") / size, count(lambda c, b: b > 127) / size,
        n / len(lines), 1 - len(set(lines)) / len(lines), n / (stops + marks + 1), alone / n, np.log(1 + max(map(len, words), default=0)),
    ]


def plain_score(model, text):
    x = plain_features(text)
    bin_of = lambda edges, v: sum(1 for e in edges if e <= v)
    z = model.bias
    for f, lookup in enumerate(model.tables):
        z += lookup[bin_of(model.edges[f], x[f])]
    for (i, j), lookup in model.pairs.items():
        z += lookup[bin_of(model.coarse[i], x[i]), bin_of(model.coarse[j], x[j])]
    return 1 / (1 + np.exp(-z))


def test_scores_match_brute_force(spark, make_docs):
    """The registered query's scores, and those of odd texts, by plain loops."""
    from tidemark.llm.queries import op6_quality

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"))
    assert model.constant is None and model.pairs
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = [r for r in op6_quality(spark, sf).collect() if len(texts[r["doc_id"]] or "") < 20_000]
    assert len(got) > 100
    off = [r["doc_id"] for r in got if abs(r["score"] - plain_score(model, texts[r["doc_id"]])) > 1e-6 or r["predicted"] != int(r["score"] >= 0.3)]
    assert not off
    odd = {1: None, 2: "", 3: "\n\n", 4: "É É É !! ?", 5: "A,b;c " * 500, 6: "{}<>= 1 2 3\n{}<>= 1 2 3"}
    assert all(abs(r["score"] - plain_score(model, odd[r["doc_id"]])) < 1e-6 for r in quality.score_quality(make_docs(list(odd.items())), model).collect())


def test_a_last_bit_changes_no_score(spark):
    """Features one bit off, as another maths library may compute them, fall into the same bins."""
    docs = table(spark, SF, "documents")
    model = quality.fit(docs, table(spark, SF, "labels"))
    x = quality.matrix([r["text"] for r in docs.where("doc_id % 7 = 0 and length(text) < 20000").collect()])
    for towards in (-np.inf, np.inf):
        assert (model.score(np.nextafter(x, towards)) == model.score(x)).all()
