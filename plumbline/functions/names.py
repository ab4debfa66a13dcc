"""Names and leagues in a form that sources can be matched by."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name suffixes and the spellings of leagues.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]
LEAGUES = {
    "ncaa": "ncaa",
    "ncaa division i": "ncaa",
    "ncaad1": "ncaa",
    "college": "ncaa",
    "cbb": "ncaa",
    "euroleague": "euroleague",
    "eurolega": "euroleague",
    "el": "euroleague",
    "g league": "gleague",
    "g-league": "gleague",
    "nba g league": "gleague",
    "gleague": "gleague",
    "nbl": "nbl",
    "australian nbl": "nbl",
    "fiba": "fiba",
    "international": "fiba",
}


def _folding() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one plain letter and marks, and those letters."""
    one = {}
    for code in range(0x80, 0x2000):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            one[chr(code)] = plain
    return "".join(one), "".join(one.values())


_MARKED, _PLAIN = _folding()


def strip_accents(x: Column) -> Column:
    """Accented letters as plain ones, combining marks left out; no Python at run time."""
    return F.regexp_replace(F.translate(x, _MARKED, _PLAIN), r"\p{M}+", "")


def normalize_name(x: Column) -> Column:
    """Plain lower case, ``Last, First`` turned round, other characters as single spaces."""
    low = F.trim(F.lower(strip_accents(x)))
    comma = F.instr(low, ",")
    turned = F.when(comma > 0, F.concat(F.expr("''"), F.substring(low, comma + 1, F.length(low)), F.lit(" "), F.substring(low, F.lit(1), comma - 1))).otherwise(low)
    return F.trim(F.regexp_replace(F.regexp_replace(turned, "[^a-z0-9 ]+", " "), " +", " "))


def name_match_key(x: Column) -> Column:
    """The normalised name without suffixes at its end."""
    endings = "|".join(SUFFIXES)
    return F.trim(F.regexp_replace(normalize_name(x), f"(^| )(({endings})( |$))+$", ""))


def normalize_league(x: Column) -> Column:
    """The league's id by its known spellings, else null."""
    table = F.create_map(*(F.lit(v) for pair in LEAGUES.items() for v in pair))
    return F.try_element_at(table, F.trim(F.lower(x)))


def season_start(x: Column) -> Column:
    """``2023-24`` as 2023; whole numbers as they are."""
    return F.split(x.cast("string"), "-")[0].try_cast("int").cast("long")
