"""Every stage of the pipeline on its own input, against brute force, with odd rows and clashing columns."""

import base64
import re

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as similarity_in
from tests.llm.test_near_copies import brute
from tidemark.llm import toxicity
from tidemark.llm.common import staged, table

SF = "/root/testdata/sf0.001"
ODD = [
    (None, None), (None, "no id"), (None, "no id"), (-1, ""), (-2, " \t"), (-3, "word"), (-4, "very long " * 30_000), (-5, "said twice"), (-5, "said twice"),
    (-6, "one id"), (-6, "and another text"),
]
EXTRA = ["kept", "digest", "fp", "score", "_key", "_stay", "_id", "_row", "_gone", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    real = table(spark, SF, "documents")
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast(real.schema["n_chars"].dataType)})
    return staged(real.unionByName(odd.select(real.columns)).withColumns({c: F.lit(f"own {c}") for c in EXTRA}), "documents")


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def stage(name, spark, docs):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    if name != "bpe":
        assert out.columns == docs.columns
        assert out.where(" or ".join(f"`{c}` <> 'own {c}'" for c in EXTRA)).isEmpty()
    return out


def test_toxicity(spark, docs):
    kept = rows(stage("toxicity", spark, docs))
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    given = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    scores, thresholds = model.judge([t for _, t, _ in given], [x for _, _, x in given])
    assert kept == sorted(((i, t) for (i, t, _), s, least in zip(given, scores, thresholds, strict=True) if s < least), key=str)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    left = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()}
    toxic, clean = ({r["doc_id"] for r in labels.where(f"toxic = {y}").collect()} for y in (1, 0))
    assert len(toxic & left) <= 0.1 * len(toxic) and len(clean & left) >= 0.97 * len(clean)


def test_exact_dedup(spark, docs):
    groups = {}
    for r in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), []).append((r["doc_id"], r["text"]))
    found = {}
    for i, text in rows(stage("exact_dedup", spark, docs)):
        found.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    assert found == {k: [min((i for i, _ in v if i is not None), default=None)] for k, v in groups.items()}


def test_near_dedup(spark, docs):
    """All rows, those without an id, of a repeated id and of one id with two texts too, against all pairs of shingle sets."""
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = brute([(k, t) for k, (_, t) in enumerate(given)])
    want = {}
    for k, (i, t) in enumerate(given):
        want.setdefault(groups[k], []).append((i is None, i or 0, i))
    kept = rows(stage("near_dedup", spark, docs))
    assert sorted((i for i, _ in kept), key=str) == sorted((min(g)[2] for g in want.values()), key=str)
    group_of = {row: groups[k] for k, row in enumerate(given)}
    assert len({group_of[row] for row in kept}) == len(kept) == len(want)


def test_decontaminate(spark, docs):
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    want = [(r["doc_id"], r["text"]) for r in docs.where("length(text) < 100000 or text is null").collect() if not any(similarity_in(r["text"], x) >= 0.8 for x in items)]
    assert [x for x in rows(stage("decontaminate", spark, docs)) if len(x[1] or "") < 100_000] == sorted(want, key=str)


def test_bpe(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = sorted(((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in stage("bpe", spark, docs).collect()), key=str)
    assert found == sorted(((r["doc_id"], library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in docs.collect()), key=str)


def test_empty_tables_pass_every_stage(spark, docs):
    for name, _ in corpus_pipeline.STAGES:
        assert stage(name, spark, docs.where("false")).count() == 0


def test_whole_run(spark):
    ran = corpus_pipeline.run(spark, SF)
    docs = table(spark, SF, "documents")
    for name, f in corpus_pipeline.STAGES:
        docs = staged(f(spark, docs, SF), name)
    assert sorted(r["doc_id"] for r in ran.collect()) == sorted(r["doc_id"] for r in docs.collect())
    assert 0 < ran.count() < table(spark, SF, "documents").count()


def test_stages_hold_few_texts_at_once(spark):
    docs = staged(spark.range(5000).selectExpr("id as doc_id", "concat('text of number ', id) as text", "'en' as lang", "'s' as source", "1 as n_chars").coalesce(1), "documents")

    def lengths(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    defaults = {"spark.sql.parquet.columnarReaderBatchSize": "4096", "spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}
    before = {key: spark.conf.get(key) for key in defaults}
    try:
        for name, f in corpus_pipeline.STAGES:
            for key, default in defaults.items():
                spark.conf.set(key, default)
            f(spark, docs if name == "decontaminate" else docs.where("false"), SF).count()
            at_once = [r["n"] for r in docs.mapInArrow(lengths, "n long").collect()]
            assert sum(at_once) == 5000 and max(at_once) <= 1024, name
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # a caller's smaller bound stays
        corpus_pipeline.drop_benchmark_leaks(spark, docs, SF)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
