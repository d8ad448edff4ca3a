"""Artist credits: one text to several artists with roles, as column expressions.

A credit is cut once at the first kind of "featuring" in it; each side is cut at commas and conjunctions,
but never inside the name of a protected act.  One regular expression does the latter: it takes whole
acts or single letters that no separator starts at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import name_key, stripped

#: What introduces a second group of artists, by priority, with their role.
INTRODUCTIONS = [(r"(?i)\s+featuring\s+", "featured"), (r"(?i)\s+feat\.?\s+", "featured"), (r"(?i)\s+ft\.?\s+", "featured"), (r"(?i)\s+with\s+", "with")]
#: Fixed value: separators within a group of artists.
SEPARATORS = r"\s*,\s*|\s+&\s+|\s+[Xx]\s+|\s+[Aa]nd\s+"
#: Acts whose names hold a separator.
PROTECTED_ACTS = [
    "Aly & AJ", "Archie Bell & The Drells", "Ashford & Simpson", "BeBe & CeCe Winans", "Big & Rich", "Blood, Sweat & Tears",
    "Bob Seger & The Silver Bullet Band", "Booker T. & The MG's", "Brooks & Dunn", "Bruce Hornsby & The Range", "Captain & Tennille",
    "Chad & Jeremy", "Cheech & Chong", "Commander Cody & His Lost Planet Airmen", "Country Joe & The Fish", "Crosby, Stills & Nash",
    "Crosby, Stills, Nash & Young", "D.J. Jazzy Jeff & The Fresh Prince", "Derek & The Dominos", "Diana Ross & The Supremes",
    "Dion & The Belmonts", "Earth, Wind & Fire", "Edie Brickell & New Bohemians", "Emerson, Lake & Palmer", "England Dan & John Ford Coley",
    "Ferrante & Teicher", "George Thorogood & The Destroyers", "Gloria Estefan & Miami Sound Machine", "Hall & Oates",
    "Hamilton, Joe Frank & Reynolds", "Heavy D & The Boyz", "Herb Alpert & The Tijuana Brass", "Hootie & The Blowfish",
    "Huey Lewis & The News", "Ike & Tina Turner", "Jan & Dean", "Jay & The Americans", "Joan Jett & The Blackhearts",
    "John Cafferty & The Beaver Brown Band", "Jr. Walker & The All Stars", "K-Ci & JoJo", "Kool & The Gang", "Lil Jon & The East Side Boyz",
    "Loggins & Messina", "Macklemore & Ryan Lewis", "Marky Mark & The Funky Bunch", "Marilyn McCoo & Billy Davis Jr.",
    "Marvin Gaye & Tammi Terrell", "Martha & The Vandellas", "Mumford & Sons", "Paul Revere & The Raiders", "Peaches & Herb",
    "Peter, Paul & Mary", "R. Kelly & Public Announcement", "Ray Parker Jr. & Raydio", "Rene & Angela", "Sam & Dave", "Seals & Crofts",
    "Selena Gomez & The Scene", "Simon & Garfunkel", "Sly & The Family Stone", "Smokey Robinson & The Miracles", "Sonny & Cher",
    "Southside Johnny & The Asbury Jukes", "The Mamas & The Papas", "Tony Orlando & Dawn", "Tyler, The Creator", "Wisin & Yandel",
]

_LONGEST_FIRST = "|".join(re.escape(a).replace(r"\ ", " ") for a in sorted(PROTECTED_ACTS, key=len, reverse=True))
_PART = rf"(?>{SEPARATORS})?((?:(?i:{_LONGEST_FIRST})|(?!{SEPARATORS})[\s\S])+)"


def _acts() -> Column:
    return F.create_map(*[F.lit(x) for a in PROTECTED_ACTS for x in (a.lower(), a)])


def protected(text: Column) -> Column:
    """The act that a text names, or null."""
    return _acts()[name_key(text)]


def group_names(segment: Column) -> Column:
    """The artists of one group."""
    parts = F.transform(F.regexp_extract_all(segment, F.lit(_PART), F.lit(1)), stripped)
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.coalesce(protected(p), p))


def segments(credit: Column) -> Column:
    """array<struct<text, role>>: the groups of a credit; none of a blank one."""
    text = stripped(credit)
    whole = F.array(F.struct(text.alias("text"), F.lit("primary").alias("role")))
    found = F.when(text.isNull() | (text == ""), F.slice(whole, 1, 0)).when(protected(text).isNotNull(), whole)
    for pattern, role in INTRODUCTIONS:
        cut = F.split(text, pattern, 2)
        side = lambda i, r: F.struct(stripped(F.get(cut, F.lit(i))).alias("text"), F.lit(r).alias("role"))  # noqa: B023, E731
        found = found.when(text.rlike(pattern), F.filter(F.array(side(0, "primary"), side(1, role)), lambda s: s["text"] != ""))
    return found.otherwise(whole)


def credited(credit: Column) -> Column:
    """array<struct<name, role>> of a credit."""

    def names(segment: Column) -> Column:
        known = protected(segment["text"])
        found = F.when(known.isNotNull(), F.array(known)).otherwise(group_names(segment["text"]))
        return F.transform(found, lambda n: F.struct(n.alias("name"), segment["role"].alias("role")))

    return F.flatten(F.transform(segments(credit), names))


def parse_credits(rows: DataFrame, key: str, known_acts: DataFrame | None = None) -> DataFrame:
    """(key, position, name, role) of (key, artist_credit): a row for each artist of a credit.

    ``known_acts`` (name) are acts that are never cut, besides the protected ones; they are joined by their
    key, first with the whole credit and then with its groups, so there may be any number of them.
    """
    if known_acts is None:
        return rows.select(key, F.posexplode(credited(F.col("artist_credit")))).select(key, F.col("pos").alias("position"), "col.name", "col.role")
    known = known_acts.select(name_key(F.col("name")).alias("_key"), stripped(F.col("name")).alias("_act")).groupBy("_key").agg(F.min("_act").alias("_act"))
    whole = rows.withColumn("_key", name_key(F.col("artist_credit"))).join(known, "_key", "left")
    one = F.array(F.struct(F.col("_act").alias("text"), F.lit("primary").alias("role")))
    groups = whole.select(key, F.posexplode(F.when(F.col("_act").isNotNull(), one).otherwise(segments(F.col("artist_credit")))).alias("_group", "_s"))
    groups = groups.withColumn("_key", name_key(F.col("_s.text"))).join(known, "_key", "left")
    text = F.col("_s.text")
    names = F.when(F.col("_act").isNotNull(), F.array("_act")).when(protected(text).isNotNull(), F.array(protected(text))).otherwise(group_names(text))
    return groups.select(key, (F.col("_group") * 1000).alias("_at"), F.posexplode(names).alias("_n", "name"), F.col("_s.role").alias("role")).select(
        key, (F.col("_at") + F.col("_n")).alias("position"), "name", "role"
    )
