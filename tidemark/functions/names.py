"""Names: keys, aliases and trigram similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A canonical name and the alternate names of the same artist.
ALIASES = {"Janet Jackson": ["Janet"], "Kesha": ["Ke$ha"]}

#: Fixed value: names are alike from this similarity.
SIMILAR = 0.3


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: Letters whose case folding is not their lower case, and what they fold to.
FOLDED = {"ß": "ss", "ẞ": "ss", "ς": "σ", "ſ": "s", "ŉ": "ʼn", "ǰ": "ǰ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def casefolded(text: Column) -> Column:
    """Case folding: lower case, but for the letters of ``FOLDED``; Greek and Armenian ligatures are left as they are."""
    for letter, folded in FOLDED.items():
        text = F.replace(text, F.lit(letter), F.lit(folded))
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))  # lower case writes a final Σ as ς


def name_key(name: Column) -> Column:
    """Case folded, single spaces."""
    return casefolded(F.regexp_replace(stripped(name), r"\s+", " "))


def canonical_name(name: Column) -> Column:
    """The canonical name of an alias, any other name as it is."""
    pairs = [F.lit(x) for canonical, others in ALIASES.items() for other in [canonical, *others] for x in (other.lower(), canonical)]
    return F.coalesce(F.create_map(*pairs)[name_key(name)], name)


def identity_key(name: Column) -> Column:
    """The same for all names of one artist."""
    return F.lower(canonical_name(name))


def identity_group(name: str) -> list[str]:
    """All names of the artist who has this one."""
    for canonical, others in ALIASES.items():
        if name.strip().lower() in {n.lower() for n in [canonical, *others]}:
            return [canonical, *others]
    return [name]


def trigrams(text: Column) -> Column:
    """The set of trigrams of each word of letters and digits, padded by two blanks in front and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = lambda w: F.concat(F.lit("  "), w, F.lit(" "))
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(padded(w), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams, 0 without any."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
