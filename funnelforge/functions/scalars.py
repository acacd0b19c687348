"""Column functions over raw text: blanks, numbers, phones, dates and durations.

Each returns null where the text does not hold what it looks for.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"

#: Date formats that are tried in turn, for day-first and month-first columns.
DAY_FIRST = ("yyyy-M-d HH:mm:ss", "yyyy-M-d", "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy")
MONTH_FIRST = ("yyyy-M-d HH:mm:ss", "yyyy-M-d", "M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "d MMM yyyy")

#: Edges of the duration bands, in months.
BAND_EDGES = (6, 12, 24, 60)


def trimmed(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only; never null itself."""
    return c.isNull() | c.rlike(r"^\s*$")


def is_blank_number(c: Column) -> Column:
    """Null or NaN."""
    return c.isNull() | F.isnan(c)


def number(c: Column) -> Column:
    """The text as a double; ``nan`` and type suffixes are no numbers."""
    t = trimmed(c)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def phone(c: Column) -> Column:
    """The last ten digits, after a trailing ``.0`` is taken off; null if there are fewer."""
    digits = F.regexp_replace(F.regexp_replace(trimmed(c), r"[.]0$", ""), r"[^0-9]", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def _shape(form: str) -> str:
    """A pattern that every text of a date format matches, by its marks and least lengths."""
    least = lambda m: {"d": ".+", "M": ".+"}.get(m[0], f".{{{len(m[0])},}}")
    return "(?s)^" + re.sub("[A-Za-z]+|[.]", lambda m: "[.]" if m[0] == "." else least(m), form)


def timestamp(c: Column, day_first: bool = True) -> Column:
    """The text as a timestamp. Year-first texts are read as such under either setting."""
    t = trimmed(c)
    # A text of another shape is not tried: a failed parse costs as much as many good ones.
    return F.coalesce(*(F.when(t.rlike(_shape(f)), F.try_to_timestamp(t, F.lit(f))) for f in (DAY_FIRST if day_first else MONTH_FIRST)))


def normal_spelling(c: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return F.regexp_replace(F.lower(trimmed(c)), r"\s+", " ")


def duration_months(c: Column) -> Column:
    """Months of texts that begin with a number of years, of months, or of both in this
    order. A unit is told by its first letter, y or m; a number without one is unknown."""
    amounts = F.regexp_extract_all(F.regexp_extract(trimmed(c), r"^([0-9]+\s*[A-Za-z]+\s*)+", 0), F.lit(r"[0-9]+\s*[A-Za-z]"), F.lit(0))
    pair = lambda x: (F.regexp_extract(x, "^[0-9]+", 0).try_cast("int"), F.lower(F.right(x, F.lit(1))))
    (n, unit), (more, its) = (pair(F.get(amounts, k)) for k in (0, 1))
    return F.when(unit == "y", n * 12 + F.coalesce(F.when(its == "m", more), F.lit(0))).when(unit == "m", n)


def duration_band(months: Column, edges: tuple[int, ...] = BAND_EDGES) -> Column:
    """``lo-hi`` for the first edge above, ``lo+`` beyond the last."""
    edges = tuple(sorted(edges))
    below = (0, *edges)
    chain = reduce(lambda w, k: w.when(months < edges[k], f"{below[k]}-{edges[k]}"), range(1, len(edges)), F.when(months < edges[0], f"0-{edges[0]}"))
    return F.when(months.isNotNull(), chain.otherwise(f"{edges[-1]}+"))


def slug(text: str) -> str:
    """A column-name form of a label."""
    out = "".join(ch if ch.isalnum() else "_" for ch in text.strip().lower())
    return "_".join(p for p in out.split("_") if p)
