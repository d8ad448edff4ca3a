"""The index of titles against the scan of all of them."""

import random

from pyspark.sql import functions as F

from tidemark.functions.names import trigrams
from tidemark.operators.search import alike
from tidemark.operators.title_index import TitleIndex, _bucket
from tidemark.sources.shared import fresh_path

WORDS = ["small", "smell", "widget", "wide", "get", "blue", "Blüe", "a", "ab", "42", "tiny-wheel", "o'clock"]


def make(spark, rows):
    return spark.createDataFrame(rows, "id long, title string")


def test_same_as_the_scan_after_changes(spark):
    rng = random.Random(4)
    title = lambda: rng.choice([None, "", " - "]) if rng.random() < 0.1 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 5)))
    rows = {i: title() for i in range(300)}
    index = TitleIndex(spark, fresh_path(spark, "index"))
    index.upsert(make(spark, list(rows.items())[:200]))
    rows |= {i: title() for i in range(0, 300, 7)}  # changed ones, some of them back to what they were
    for _ in range(2):
        index.upsert(make(spark, list(rows.items())))
    assert index.versions.latest().number == 2  # the second time nothing is new
    for query in ("small widget", "blue", "tiny wheel 42", "nothing like it", "small small small"):
        wanted = sorted((r["id"], r["sim"]) for r in alike(make(spark, list(rows.items())), "title", query).collect())
        assert sorted((r["id"], r["sim"]) for r in index.alike(query).collect()) == wanted
        cut = sorted((s for _, s in wanted), reverse=True)[:5]
        best = {r["id"]: (r["title"], r["sim"]) for r in index.best(query, 5).collect()}
        assert best == {i: (rows[i], s) for i, s in wanted if s >= cut[-1]}


def test_reads_the_buckets_of_the_query_alone(spark):
    index = TitleIndex(spark, fresh_path(spark, "index"))
    version = index.upsert(make(spark, [(i, " ".join(random.Random(i).sample(WORDS, 3))) for i in range(200)]))
    wanted = {str(r[0]) for r in spark.range(1).select(F.explode(trigrams(F.lit("blue"))).alias("g")).select(_bucket(F.col("g"))).collect()}
    found = index.alike("blue")
    read = {f.split("/postings/_part=")[1].split("/")[0].split(".")[0] for f in found.inputFiles()}
    assert read <= wanted and len(read) < len(version.tables["postings"])
    plan = found._jdf.queryExecution().toString()
    assert "In(trigram" in plan.split("PushedFilters")[1] and "GreaterThanOrEqual(n," in plan and "/titles/" not in plan


def test_empty_index(spark):
    index = TitleIndex(spark, fresh_path(spark, "index"))
    assert index.is_empty and index.alike("blue").collect() == [] == index.best("blue", 5).collect()
    index.upsert(make(spark, []))
    assert index.is_empty
