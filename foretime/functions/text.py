"""Parsing of short strings, and names."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with a stroke, which no decomposition takes apart, and the plain ones.
_STROKED, _UNSTROKED = "đłøħŧ", "dloht"


def _fold(ch: str) -> str:
    """A sign taken apart (NFKD), without combining marks, in folded case."""
    return "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)).casefold()


@cache
def _fold_tables() -> tuple[str, str, str, str, str]:
    """By the rule of _fold over all code points: signs that become one sign and those signs (signs that vanish stand last, without one), signs that become several and what they become, and a pattern of the latter."""
    one, to, gone, many, parts = [], [], [], [], []
    for k in (*range(0xD800), *range(0xE000, 0x110000)):
        if k < 128 and not 65 <= k <= 90:
            continue
        ch = chr(k)
        new = _fold(ch)
        if new == ch:
            continue
        if len(new) == 1:
            one.append(ch)
            to.append(new)
        elif new:
            many.append(k)
            parts.append(new)
        else:
            gone.append(ch)
    # neighbouring code points as ranges
    runs: list[list[int]] = []
    for k in many:
        if runs and runs[-1][1] == k - 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    pattern = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"
    return "".join(one + gone), "".join(to), "\u0001".join(map(chr, many)), "\u0001".join(parts), pattern


def folded(c: Column) -> Column:
    """A text with every sign taken apart to its plain letters (NFKD), without marks, in folded case: the same for all ways of writing a name.

    Nearly all of it is one translation; only texts that have a sign of several letters, such as a ligature, are gone through sign by
    sign.
    """
    one, to, many, parts, pattern = _fold_tables()
    plain = F.translate(c, one, to)
    known = F.map_from_arrays(F.split(F.lit(many), "\u0001"), F.split(F.lit(parts), "\u0001"))
    signs = F.regexp_extract_all(plain, F.lit(r"(?s)."), 0)
    return F.when(plain.rlike(pattern), F.array_join(F.transform(signs, lambda x: F.coalesce(F.try_element_at(known, x), x)), "")).otherwise(plain)


def _number(c: Column, pattern: str, k: int) -> Column:
    """A group of the pattern as int; NULL for strings that don't fit. Only what fits is cast, as a cast that fails builds an error and drops it, row by row."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k).try_cast("int"))


def clock_seconds(c: Column) -> Column:
    """"MM:SS" in seconds; anything else is 0."""
    part = lambda k: _number(c, r"^(\d+):(\d{2})$", k)
    return F.coalesce(part(1) * 60 + part(2), F.lit(0))


def fraction(c: Column) -> Column:
    """"19/21" as struct(made, tried); malformed strings give zeros."""
    part = lambda k: F.coalesce(_number(c, r"^(\d+)/(\d+)$", k), F.lit(0))
    return F.struct(part(1).alias("made"), part(2).alias("tried"))


def strength(c: Column, default: int = 5, low: int = 3, high: int = 6) -> Column:
    """"5v4" as struct(own, other), each clipped."""
    part = lambda k: F.greatest(F.least(F.coalesce(_number(c, r"^(\d+)v(\d+)$", k), F.lit(default)), F.lit(high)), F.lit(low))
    return F.struct(part(1).alias("own"), part(2).alias("other"))


def american(c: Column) -> Column:
    """A price in any usual spelling as int: signs, EVEN, decimal odds between 1 and 20 with a point; under 100 in size it is NULL."""
    t = F.upper(F.trim(c))
    n = F.regexp_replace(t, r"^\+", "").try_cast("double")
    from_decimal = F.when(n >= 2, F.round((n - 1) * 100)).when(n > 1, F.round(-100 / (n - 1)))
    return F.when(t.isin("EVEN", "EV"), F.lit(100.0)).when(t.contains(".") & (n > 1) & (n < 20), from_decimal).when(F.abs(n) >= 100, F.round(n)).cast("int")


def line(c: Column) -> Column:
    """o6.5, u6.5, PK or a number as double."""
    t = F.upper(F.trim(c))
    return F.when(t.isin("PK", "PICK"), F.lit(0.0)).otherwise(F.regexp_replace(t, r"^[OU]\s*", "").try_cast("double"))


def milestone(c: Column) -> Column:
    """"3+" is the line 2.5."""
    return _number(F.trim(c), r"^(\d+)\+$", 1) - F.lit(0.5)


def plain_name(c: Column) -> Column:
    """A folded name without points and apostrophes, single spaces; a stroked o or l and the like, which have no plain letter in them, as that letter."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(folded(c), _STROKED, _UNSTROKED), r"[.'’]", ""), r"[\s-]+", " "))


def initial_and_surname(c: Column) -> Column:
    """struct(initial, surname) of a plain name; NULL without a surname."""
    n = plain_name(c)
    surname = F.regexp_extract(n, r"^\S+ (.+)$", 1)
    return F.when(surname != "", F.struct(F.substring(n, 1, 1).alias("initial"), surname.alias("surname")))


def venue_key(c: Column) -> Column:
    """A venue's name as key: lower case letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def rows_hash(columns: list[Column]) -> Column:
    """An aggregate: SHA-256 of the set of rows, whatever their order."""
    row = F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns])
    return F.sha2(F.array_join(F.array_sort(F.collect_set(row)), "\u0002"), 256)


def event_ticker(c: Column) -> Column:
    """struct(day, teams) of tickers as SERIES-25DEC10AAABBB; NULL for others and for days that don't exist."""
    pattern = r"^[A-Z]+-(\d{2})([A-Z]{3})(\d{2})([A-Z]+)$"
    day = F.try_to_date(F.concat_ws("-", F.concat(F.lit("20"), F.regexp_extract(c, pattern, 1)), F.initcap(F.lower(F.regexp_extract(c, pattern, 2))), F.regexp_extract(c, pattern, 3)), "yyyy-MMM-dd")
    return F.when(day.isNotNull(), F.struct(day.alias("day"), F.regexp_extract(c, pattern, 4).alias("teams")))


def market_code(c: Column) -> Column:
    """What stands after the last hyphen of a ticker of three parts."""
    return F.when(F.size(F.split(c, "-")) >= 3, F.nullif(F.substring_index(c, "-", -1), F.lit("")))
