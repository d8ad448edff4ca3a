"""Sharding by sampled splitters: shards of nearly equal bytes.

1. Every record gets a sort key (hash of the text, doc_id, row number), so equal texts lie side by side while
   any two records, repeated rows too, can still be cut apart.
2. A size-weighted sample of keys is drawn: a record of s bytes is drawn floor(s / step) times and once
   more with probability frac(s / step), by a hash of its key, so a retried task draws the same sample.
   Its expected length is a parameter, whatever the input's size.
3. Quantiles of the sample become range boundaries; each record finds its range by binary search.
4. Ranges are measured; those that hold more than twice the mean bytes besides their largest record are
   subdivided, each by a denser sample of its own keys, until none is left.  A range in which a whole round
   draws no key to cut at stays as it is, and the others go on.
5. Running bytes inside each range plus the bytes of the ranges before it give each record its place
   in the whole order, and the place gives the shard and the slot.  The splitters decide which records
   follow each other in a range and what a task holds; a shard is a run of whole ranges, and the range
   at its end is cut where its bytes are full.  So shards differ by less than one record's size, which
   boundaries from a sample alone cannot promise.

Only DataFrame functions run here.  A null text has no bytes and the CRC of an empty text; a null
``doc_id`` sorts first; repeated rows follow each other in any order; long texts are one record; columns
besides doc_id (a whole number) and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

SHARDS = 40
#: Bytes that each record has besides its text.
RECORD_BYTES = 16
#: Sampled keys for each range: a range's size then varies by about a tenth.
SAMPLES_A_RANGE = 64
#: Ranges are sized for tasks, and bounded because their boundaries are held by the driver.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 256 << 20, 160, 2048


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, k, row): k is the hash part of the sort key, row differs for each once this is staged."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k"),
        F.monotonically_increasing_id().alias("row"),
    )


def _key():
    return F.struct(F.col("k"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.col("row"))


Key = tuple[int, int, int]


def sample_keys(sized: DataFrame, step: float, round_no: int = 0) -> list[Key]:
    """Keys drawn about once every ``step`` bytes; returns the sorted list."""
    chance = F.pmod(F.xxhash64("k", "doc_id", "row", F.lit(round_no)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.floor(F.col("size") / F.lit(step) + chance).cast("int")
    drawn = sized.withColumn("_times", times).where("_times > 0")
    rows = drawn.select(_key().alias("key"), F.explode(F.array_repeat(F.lit(1), F.col("_times"))).alias("_one")).select("key.*")
    return sorted((r["k"], r["id"], r["row"]) for r in rows.collect())


def splitters(keys: list[Key], ranges: int) -> list[Key]:
    """At most ``ranges`` - 1 different boundaries at the quantiles of the sample."""
    n = len(keys)
    return sorted({keys[i * n // ranges] for i in range(1, ranges)}) if n else []


def subdivided(bounds: list[Key], keys: list[Key], over: list[int], parts: int = 5) -> dict[int, list[Key]]:
    """New boundaries within each of the ranges ``over`` in which a sampled key allows one, at the quantiles of its own keys.

    Where a record that already bounds its range takes all quantiles, the range is cut in the middle of its other keys.
    """
    of_range = {r: [] for r in over}
    for key in keys:
        if (r := bisect_right(bounds, key)) in of_range:
            of_range[r].append(key)
    found = {}
    for r, own in of_range.items():
        own_bound = bounds[r - 1] if r else None
        others = sorted({k for k in own if k != own_bound})
        found[r] = [k for k in splitters(own, parts) if k != own_bound] or splitters(others, 2)
    return {r: cuts for r, cuts in found.items() if cuts}


def _constants(structs: list[str]):
    """An array of constant structs, parsed in one go."""
    return F.expr(f"array({', '.join(structs)})")


def range_of(bounds: list[Key]):
    """The number of boundaries at or below the key, by binary search in an array of constants."""
    if not bounds:
        return F.lit(0)
    array = _constants([f"named_struct('k', {k}L, 'id', {i}L, 'row', {r}L)" for k, i, r in bounds])
    n = len(bounds)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(array, F.least(at + step, F.lit(n)) - 1) <= _key()), at + step).otherwise(at),
    )


def shard(docs: DataFrame, shards: int = SHARDS, samples_a_range: int = SAMPLES_A_RANGE) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    sized = staged(records(docs), "records")
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    ranges = min(MOST_RANGES, max(LEAST_RANGES, math.ceil(total / RANGE_BYTES)))
    step = max(1.0, total / (ranges * samples_a_range))
    bounds = splitters(sample_keys(sized, step), ranges)

    def measured():
        placed = sized.withColumn("range", range_of(bounds))
        found = placed.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("largest"))
        return {r["range"]: (r["b"], r["n"], r["largest"]) for r in found.collect()}  # a row for each range

    sizes = measured()
    round_no, uncut = 0, set()  # the first boundaries of ranges in which a whole round found no key to cut at

    def overfull() -> list[int]:
        """The ranges that hold too much besides their largest record, which no boundary can cut: fewer than half of all."""
        most = 2 * max(1, total // ranges)
        return [r for r, (b, _, largest) in sizes.items() if b - largest > most and (bounds[r - 1] if r else None) not in uncut]

    while over := overfull():
        round_no += 1
        inside = sized.withColumn("range", range_of(bounds)).where(F.col("range").isin(over))
        more = subdivided(bounds, sample_keys(inside, step / 8, round_no), over)
        uncut |= {bounds[r - 1] if r else None for r in over if r not in more}
        if more:
            bounds = sorted({*bounds, *(k for cuts in more.values() for k in cuts)})
            sizes = measured()

    starts, bytes_before, rows_before = [], 0, 0
    for r in range(len(bounds) + 1):
        starts.append((bytes_before, rows_before))
        b, n, _ = sizes.get(r, (0, 0, 0))
        bytes_before, rows_before = bytes_before + b, rows_before + n
    start = F.get(_constants([f"named_struct('b', {b}L, 'n', {n}L)" for b, n in starts]), F.col("range"))

    in_range = Window.partitionBy("range").orderBy("k", F.col("doc_id").asc_nulls_first(), "row")
    running = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        sized.withColumn("range", range_of(bounds))
        .withColumn("_upto", F.sum("size").over(running))
        .withColumn("_row", F.row_number().over(in_range))
        .withColumn("_start", start)
        .select(
            "doc_id", "size", "text_crc32",
            (F.col("_start.b") + F.col("_upto") - F.col("size")).alias("_at"),
            (F.col("_start.n") + F.col("_row") - 1).alias("_rank"),
        )
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"_at * {shards} div {max(1, total)}")).cast("int"))
    )
    placed = staged(placed.drop("_at"), "placed")
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot")
    )
