"""Data quality: gaps, coverage, broken rows, genders and the reconciliation of credits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.credits import parse_credits
from tidemark.functions.names import canonical_name, name_key
from tidemark.operators.charts import available_dates
from tidemark.operators.stats import artist_chart_stats
from tidemark.sources.projection import GENDERS, Tables

# -- weeks ------------------------------------------------------------------------------------


def missing_weeks(t: Tables) -> DataFrame:
    """(chart_id, chart_date): Saturdays between a chart's first and last week that counts which have none."""
    present = available_dates(t)
    ends = present.groupBy("chart_id").agg(F.min("chart_date").alias("a"), F.max("chart_date").alias("b"))
    expected = ends.select("chart_id", F.explode(F.sequence("a", "b", F.expr("interval 7 day"))).alias("chart_date"))
    return expected.join(present, ["chart_id", "chart_date"], "left_anti")


def week_ranges(dates: DataFrame, by: str = "chart_id") -> DataFrame:
    """(by, first_date, last_date, weeks): islands of consecutive Saturdays."""
    number = F.row_number().over(Window.partitionBy(by).orderBy("chart_date"))
    island = F.expr("date_sub(chart_date, 7 * _n)")
    marked = dates.distinct().withColumn("_n", number).withColumn("_island", island)
    return marked.groupBy(by, "_island").agg(F.min("chart_date").alias("first_date"), F.max("chart_date").alias("last_date"), F.count("*").alias("weeks")).drop("_island")


def completeness(t: Tables) -> DataFrame:
    """(chart_id, expected, missing, percent): how much of a chart's calendar there is."""
    present = available_dates(t).groupBy("chart_id").agg(
        F.count("*").alias("present"), (F.floor(F.datediff(F.max("chart_date"), F.min("chart_date")) / 7) + 1).alias("expected")
    )
    return present.select("chart_id", "expected", (F.col("expected") - F.col("present")).alias("missing"), (F.col("present") / F.col("expected") * 100).alias("percent"))


def integrity_counts(t: Tables) -> DataFrame:
    """(check, n): rows that break a rule of the model; and links by role."""
    entries, weeks = t.entries, t.weeks
    rules = {
        "entries without a rank": entries.where("rank is null or rank < 1"),
        "ranks twice in a week": entries.groupBy("week_id", "rank").count().where("count > 1"),
        "dates twice in a chart": weeks.groupBy("chart_id", "chart_date").count().where("count > 1"),
        "entries without a week": entries.join(weeks.select(F.col("id").alias("week_id")), "week_id", "left_anti"),
        "song links without an artist": t.song_artists.join(t.artists.select(F.col("id").alias("artist_id")), "artist_id", "left_anti"),
        "album links without an artist": t.album_artists.join(t.artists.select(F.col("id").alias("artist_id")), "artist_id", "left_anti"),
        "artists of an unlisted gender": t.artists.where(~F.col("gender").isin(GENDERS)),
        "primary song links": t.song_artists.where("role = 'primary'"),
        "featured song links": t.song_artists.where("role = 'featured'"),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n") for name, df in rules.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# -- genders ----------------------------------------------------------------------------------

#: Fixed values of the two catalogues.
ENSEMBLE_TYPES, PERSON_TYPES = ["group", "choir", "orchestra"], ["person", "character"]
HUMAN, MALE, FEMALE = "Q5", "Q6581097", "Q6581072"
LEAST_SCORE, TIE_MARGIN = 90, 5


def gender_of_type(kind: Column, gender: Column) -> Column:
    """A type and a gender as one of the five genders; ensembles never read the gender."""
    kind, gender = F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lower(F.trim(F.coalesce(gender, F.lit(""))))
    return F.when(kind.isin(ENSEMBLE_TYPES), "group").when(kind.isin(PERSON_TYPES) & gender.isin("female", "male"), gender).otherwise("unknown")


def gender_of_classes(classes: Column, sex: Column, ensembles: list[str]) -> Column:
    """Classes and a sex as one of the five genders; a class of ensembles wins."""
    of_human = F.when(sex == MALE, "male").when(sex == FEMALE, "female").otherwise("unknown")
    listed = F.array(*map(F.lit, ensembles))
    return F.when(F.arrays_overlap(classes, listed), "group").when(F.array_contains(classes, HUMAN), of_human).otherwise("unknown")


def best_candidates(candidates: DataFrame) -> DataFrame:
    """(name, candidate_id, type, gender): the surest candidate of each name.

    ``candidates``: name, candidate_id, score, type, gender.  None is chosen below a score of 90, or if the
    second is within five points and of another type.
    """
    order = Window.partitionBy("name").orderBy(F.desc("score"), F.desc("candidate_id"))
    kind = F.lower(F.trim(F.coalesce("type", F.lit(""))))
    next_ = lambda c: F.lead(c).over(order)
    rows = candidates.withColumn("_n", F.row_number().over(order)).withColumn("_score", next_("score")).withColumn("_kind", kind)
    rows = rows.withColumn("_other", next_("_kind")).where((F.col("_n") == 1) & (F.col("score") >= LEAST_SCORE))
    doubtful = (F.col("_score") >= LEAST_SCORE) & (F.col("score") - F.col("_score") <= TIE_MARGIN) & (F.col("_kind") != F.col("_other"))
    return rows.where(~F.coalesce(doubtful, F.lit(False))).select("name", "candidate_id", "type", gender_of_type(F.col("type"), F.col("gender")).alias("gender"))


def resolved_genders(names: DataFrame, primary: DataFrame, fallback: DataFrame, ensembles: list[str]) -> DataFrame:
    """(name, gender, source, source_id) of the names that a catalogue settles.

    ``primary``: candidates as in ``best_candidates``.  A sure candidate ends the search, also one whose type and gender
    say nothing: the name stays unknown, but its source is kept.  Only names without one are looked up in ``fallback``
    (name, source_id, classes, sex), where an unknown gender settles nothing.
    """
    wanted = names.select("name").distinct()
    first = wanted.join(best_candidates(primary), "name").select("name", "gender", F.lit("first").alias("source"), F.col("candidate_id").alias("source_id"))
    mapped = gender_of_classes(F.col("classes"), F.col("sex"), ensembles)
    other = fallback.select("name", mapped.alias("gender"), "source_id").where("gender <> 'unknown'")
    other = other.groupBy("name").agg(F.min_by("gender", "source_id").alias("gender"), F.min("source_id").alias("source_id"))
    second = wanted.join(first.select("name"), "name", "left_anti").join(other, "name")
    return first.unionByName(second.select("name", "gender", F.lit("second").alias("source"), "source_id"))


def gender_coverage(t: Tables) -> DataFrame:
    """(gender, n, percent) of the five genders, those without artists too."""
    vocabulary = t.artists.sparkSession.createDataFrame([(g,) for g in GENDERS], "gender string")
    counts = t.artists.groupBy("gender").agg(F.count("*").alias("n"))
    total = F.broadcast(t.artists.agg(F.count("*").alias("_all")))  # one row
    rows = vocabulary.join(counts, "gender", "full").crossJoin(total)
    n = F.coalesce("n", F.lit(0))
    return rows.select("gender", n.alias("n"), F.when(F.col("_all") > 0, n / F.col("_all")).otherwise(F.lit(0.0)).alias("share"))


def gender_coverage_by_source(t: Tables) -> DataFrame:
    total = F.broadcast(t.artists.agg(F.count("*").alias("_all")))  # one row
    counts = t.artists.groupBy(F.coalesce("gender_source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))
    return counts.crossJoin(total).select("source", "n", (F.col("n") / F.col("_all")).alias("share"))


def gender_coverage_weighted(t: Tables) -> DataFrame:
    """One row: the chart weeks of all artists and of those with a gender."""
    weeks = artist_chart_stats(t).join(t.artists.select(F.col("id").alias("artist_id"), "gender"), "artist_id")
    sums = weeks.agg(F.coalesce(F.sum("total_weeks"), F.lit(0)).alias("total_weight"), F.coalesce(F.sum(F.when(F.col("gender") != "unknown", F.col("total_weeks"))), F.lit(0)).alias("matched_weight"))
    return sums.withColumn("share", F.when(F.col("total_weight") > 0, F.col("matched_weight") / F.col("total_weight")).otherwise(F.lit(0.0)))


# -- reconciliation of credits ----------------------------------------------------------------


def known_acts(artists: DataFrame) -> DataFrame:
    """(name): artists whose names hold a separator."""
    return artists.where(F.col("name").contains(",") | F.col("name").contains(" & ")).select("name")


def target_links(items: DataFrame, artists: DataFrame) -> DataFrame:
    """(entity_id, key, name, role) that the credits of items (id, artist_credit) ask for; the first role counts."""
    credits = items.select(F.col("id").alias("entity_id"), "artist_credit")
    parsed = parse_credits(credits, "entity_id", known_acts(artists)).withColumn("name", canonical_name(F.col("name")))
    keyed = parsed.withColumn("key", name_key(F.col("name")))
    first = lambda c: F.min_by(c, "position").alias(c)
    return keyed.groupBy("entity_id", "key").agg(first("name"), first("role"))


def link_changes(items: DataFrame, links: DataFrame, artists: DataFrame) -> DataFrame:
    """(entity_id, key, name, role, artist_id, change): links to add or to remove, so that they follow the credits."""
    target = target_links(items, artists)
    named = artists.select(F.col("id").alias("artist_id"), name_key(F.col("name")).alias("key"))
    current = links.select("entity_id", "artist_id").distinct().join(named, "artist_id", "left").withColumn("key", F.coalesce("key", F.concat(F.lit("?"), F.col("artist_id").cast("string"))))
    both = target.join(current, ["entity_id", "key"], "full")
    change = F.when(F.col("artist_id").isNull(), "add").when(F.col("name").isNull(), "remove")
    return both.withColumn("change", change).where("change is not null")


def orphans(artists: DataFrame, plans: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(id, name, deletable): artists whom no link would keep; deletable if no credit names them.

    ``plans``: (items, links) of each kind.
    """
    kept = named = None
    for items, links in plans:
        target = target_links(items, artists).select("key").distinct()
        changes = link_changes(items, links, artists).where("change = 'remove'").select("entity_id", "artist_id")
        stay = links.select("entity_id", "artist_id").join(changes, ["entity_id", "artist_id"], "left_anti").select("artist_id")
        kept, named = (stay, target) if kept is None else (kept.unionByName(stay), named.unionByName(target))
    keyed = artists.select("id", "name", name_key(F.col("name")).alias("key"))
    gone = keyed.join(kept.distinct().withColumnRenamed("artist_id", "id"), "id", "left_anti")
    produced = named.distinct().withColumn("_named", F.lit(True))
    marked = gone.join(produced, "key", "left")
    return marked.select("id", "name", F.col("_named").isNull().alias("deletable"))


def reconciled_links(items: DataFrame, links: DataFrame, artists: DataFrame) -> DataFrame:
    """(entity_id, key): the links as ``link_changes`` leaves them."""
    changes = link_changes(items, links, artists)
    named = artists.select(F.col("id").alias("artist_id"), name_key(F.col("name")).alias("key"))
    removed = changes.where("change = 'remove'").select("entity_id", "artist_id")
    stay = links.select("entity_id", "artist_id").distinct().join(removed, ["entity_id", "artist_id"], "left_anti").join(named, "artist_id")
    return stay.select("entity_id", "key").unionByName(changes.where("change = 'add'").select("entity_id", "key")).distinct()


def broken_invariants(items: DataFrame, before: DataFrame, after: DataFrame, deleted: DataFrame, artists: DataFrame) -> DataFrame:
    """(rule, entity_id, key): what a reconciliation has broken; no row if it is right.

    ``before`` and ``after``: links (entity_id, key); ``deleted``: keys of artists that are gone.  No item may lose all its
    artists; an item whose credit names artists has exactly these; no artist whom a credit names may be gone.
    """
    target = target_links(items, artists).select("entity_id", "key").distinct()
    lost = before.select("entity_id").distinct().join(after.select("entity_id"), "entity_id", "left_anti")
    missing = target.join(after.select("entity_id", "key"), ["entity_id", "key"], "left_anti")
    judged = after.select("entity_id", "key").distinct().join(target.select("entity_id"), "entity_id", "left_semi")
    surplus = judged.join(target, ["entity_id", "key"], "left_anti")
    gone = deleted.select("key").distinct().join(target.select("key"), "key", "left_semi")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    item = items.schema["id"].dataType
    parts = [
        lost.select(F.lit("without artists").alias("rule"), "entity_id", none("key", "string")), missing.select(F.lit("missing").alias("rule"), "entity_id", "key"),
        surplus.select(F.lit("unexpected").alias("rule"), "entity_id", "key"), gone.select(F.lit("deleted").alias("rule"), none("entity_id", item), "key"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
