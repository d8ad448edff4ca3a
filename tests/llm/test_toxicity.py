import zlib

import numpy as np

from tidemark.llm import toxicity as tox
from tidemark.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = {r["doc_id"]: r for r in tox.score_toxicity(docs, tox.fit(docs, labels)).collect()}
    assert len(scored) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scored.items())
    pairs = [(scored[r["doc_id"]]["score"] >= 0.5, r["toxic"]) for r in labels.collect() if scored[r["doc_id"]]["held_out"]]
    hits = sum(p and t for p, t in pairs)
    assert hits / sum(t for _, t in pairs) > 0.8 and hits / sum(p for p, _ in pairs) > 0.8


def test_parts_do_not_change_scores():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 2, 3, 50, 400)] * 10
    labels = np.array([i % 2 for i in range(len(texts))], np.float32)
    model = tox.TextCNN().train([tox.words_of(t) for t in texts], labels)
    whole = model.scorer().score(texts)
    old = tox.PART_WORDS, tox.MEMO_WORDS
    tox.PART_WORDS, tox.MEMO_WORDS = 7, 40
    try:
        assert np.allclose(model.scorer().score(texts), whole, atol=1e-5)
        assert np.allclose([model.scorer().score([t])[0] for t in texts], whole, atol=1e-5)
    finally:
        tox.PART_WORDS, tox.MEMO_WORDS = old


def test_edge_cases(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "123 !!"), (None, "a"), (5, "idiot"), (5, "idiot"), (6, "w " * 80_000)]
    docs = make_docs(rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(5, 1, 1), (None, 1, 0), (2, None, None), (1, 0, 0)], none.schema)):
        model = tox.fit(docs, labels)
        got = tox.score_toxicity(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
        assert tox.score_toxicity(make_docs([]), model).count() == 0
    kept = tox.drop_toxic(docs, tox.fit(docs, none))
    assert kept.columns == docs.columns and kept.count() == len(rows)


def plain_score(model, text):
    """The model's answer by loops over words, filters and widths."""
    if model.constant is not None:
        return model.constant
    words = tox.words_of(text)
    vector = lambda i: sum((model.embedding[b].astype(float) for b in tox.features(words[i])), np.zeros(tox.DIMENSIONS)) if i < len(words) else np.zeros(tox.DIMENSIONS)
    vectors = [vector(i) for i in range(len(words) + max(tox.WIDTHS))]
    total, unit = float(model.out_bias), 0
    for width, kernel in zip(tox.WIDTHS, model.filters):
        for f in range(tox.FILTERS):
            best = max(sum(float(vectors[i + k] @ kernel[k][:, f]) for k in range(width)) for i in range(max(1, len(words))))
            total += max(0.0, best + float(model.bias[unit])) * float(model.out[unit])
            unit += 1
    return 1 / (1 + np.exp(-total))


def test_scores_match_brute_force(spark, make_docs):
    """The registered query's scores of short real texts, and odd ones, by plain loops."""
    from tidemark.llm.queries import op5_toxicity

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = tox.fit(docs, table(spark, sf, "labels"))
    assert model.cnn.constant is None
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = 0
    for r in op5_toxicity(spark, sf).collect():
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if len(texts[r["doc_id"]] or "") < 2500:
            assert abs(r["score"] - plain_score(model.cnn, texts[r["doc_id"]])) < 1e-4
            seen += 1
    assert seen > 100
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "a"), (5, "two words"), (6, "É" * 50)]
    assert all(abs(r["score"] - plain_score(model.cnn, dict(odd)[r["doc_id"]])) < 1e-4 for r in tox.score_toxicity(make_docs(odd), model).collect())


def test_long_texts_are_scored_but_not_learnt_from(spark, make_docs):
    from tidemark.llm import labels

    rows = [(i, "short") for i in range(40)] + [(50 + i, "w " * 20_000) for i in range(20)]
    marks = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    sample = labels.training_rows(make_docs(rows), marks, "toxic")
    assert sample and {r["text"] for r in sample} == {"short"}
    assert tox.score_toxicity(make_docs(rows), tox.fit(make_docs(rows), marks)).count() == len(rows)


def test_learns_from_every_labelled_row(spark, make_docs, monkeypatch):
    """More rows than a shard, and long ones: the words of all of them have weight, and shards agree on one model."""
    monkeypatch.setattr(tox, "SHARD_ROWS", 60, raising=False)
    monkeypatch.setattr("tidemark.llm.labels.TRAINING_ROWS", 60)
    monkeypatch.setattr("tidemark.llm.labels.training_rows.__defaults__", (60,))
    rows = [(i, "calm words here " * 3 + ("vilest" if i % 2 else "kind")) for i in range(400)] + [(400 + i, "grubby " + "w " * 20_000) for i in range(24)]
    marks = spark.createDataFrame([(i, 1, i % 2 if i < 400 else 1) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = tox.fit(make_docs(rows), marks)
    bad, good, long_ = (r["score"] for r in tox.score_toxicity(make_docs([(1, "vilest"), (2, "kind"), (3, "grubby")]), model).orderBy("doc_id").collect())
    assert bad > 0.5 > good and long_ > 0.5


def test_features_of_many_words():
    rng = np.random.default_rng(2)
    letters = list("abcdefghéßł中文\U00020000а²Ⅷ")
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 40, 3000)] + ["a", "x" * 32, "y" * 33, "é" * 50, "z" * 5000]
    assert tox.features_of(words).tolist() == [tox.features(w) for w in words]
    assert tox.features_of([]).shape == (0, 1 + len(tox.PREFIXES))


def test_shards_follow_the_rows_and_sums_the_cores(spark, make_docs, monkeypatch):
    """More partitions than were asked for make no smaller shards, and more shards than cores send no more arrays."""
    from pyspark import TaskContext

    sizes, tasks, cores = [], [], spark.sparkContext.defaultParallelism
    fitted, frame = tox._fitted, type(make_docs([]))
    deal = frame.repartition
    of_task = lambda shard: np.eye(100, dtype=np.float32)[TaskContext.get().partitionId()]

    def seen(shards):
        sizes.append([r["n"] for r in shards.select("n").collect()])
        tasks.append(tox._over_shards(shards, of_task))
        return fitted(shards)

    monkeypatch.setattr(tox, "_fitted", seen)
    monkeypatch.setattr(frame, "repartition", lambda self, n, *by: deal(self, max(n, 40) if by else n, *by))
    monkeypatch.setattr(tox, "EPOCHS", (1, 2))
    rows = [(i, "calm words here " + ("vilest" if i % 2 else "kind")) for i in range(400)]
    marks = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    tox.fit(make_docs(rows), marks)
    assert len(sizes[0]) == 1 and sizes[0][0] > 200
    monkeypatch.setattr(tox, "SHARD_ROWS", 10)
    tox.fit(make_docs(rows), marks)
    assert len(sizes[1]) == tasks[1].sum() > cores >= (tasks[1] > 0).sum()
