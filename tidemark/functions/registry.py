"""What a chart's slug says: family, kind of entity, depth and title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families in display order, and the slug prefixes of the genres.
FAMILIES = ["Core", "Artist", "Country", "Latin", "R&B/Hip-Hop", "Rock"]
GENRE_PREFIXES = {"country-": "Country", "latin-": "Latin", "r-b-hip-hop-": "R&B/Hip-Hop", "rock-": "Rock"}
#: Kind, depth and title by the end of a slug, and of any other slug.
SUFFIX_META = {"-songs": ("song", 50, "this chart"), "-albums": ("album", 50, "this chart")}
OTHER_META = ("song", 100, "this chart")


def family(slug: Column, category: Column) -> Column:
    """Core and artist charts by category, others by the genre in the slug, unknown ones as core."""
    found = F.when(category == "core", "Core").when(category == "artist", "Artist")
    for prefix, name in GENRE_PREFIXES.items():
        found = found.when(slug.startswith(prefix), name)
    return found.otherwise("Core")


def family_position(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, FAMILIES)), name)


def chart_metadata(charts: DataFrame, exact: DataFrame) -> DataFrame:
    """(slug, kind, depth, title) of every slug: what ``exact`` (slug, kind, depth, title: the known charts) says, else by the slug's end."""
    known = F.broadcast(exact.select(F.col("slug"), F.struct("kind", "depth", "title").alias("_known")))  # a registry
    struct = lambda meta: F.struct(*[F.lit(v).alias(n) for v, n in zip(meta, ("kind", "depth", "title"), strict=True)])
    meta = F.coalesce("_known", *[F.when(F.col("slug").endswith(end), struct(m)) for end, m in SUFFIX_META.items()], struct(OTHER_META))
    return charts.select("slug").join(known, "slug", "left").select("slug", meta.alias("m")).select("slug", "m.*")
