"""Data-quality findings over tables of text columns.

All but duplicate rows derives from one table: how often each column has each value.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelforge.functions.scalars import is_blank, normal_spelling, number, timestamp, trimmed
from funnelforge.operators.position import ordered_position, quantiles, ranged, top_per
from funnelforge.session import stored

#: Thresholds of the findings.
NUMERIC_SHARE = 0.9
DATE_SHARE = 0.7
FUZZY_LENGTH, FUZZY_RATIO, FUZZY_DISTINCT, FUZZY_SHARE, FUZZY_PAIRS = 5, 0.65, 300, 0.3, 15
SENTINEL_ROWS, SENTINEL_SHARE = 30, 0.01
CLUSTER_LOW, CLUSTER_HIGH, CLUSTER_GAP = 0.005, 0.95, 0.15
FLOAT_ID_SHARE = 0.5
SHOWN = 100
#: Texts of a block that is compared with another at once.
BLOCK = 512
MULTI_SHARE, DELIMITERS = 0.05, (";", "|", ",")
FREE_ROWS, FREE_DISTINCT, FREE_SINGLE = 20, 0.5, 0.5
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)

#: What dates look like.
_NUMERIC_DATE = r"^([0-9]{1,4})[/\-.]([0-9]{1,4})[/\-.]([0-9]{1,4})$"
_TEXT_DATE = r"(?i)^[0-9]{1,2}\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+[0-9]{2,4}$"


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col, value, n): how often each column has each value, nulls too; one shuffle."""
    columns = columns or df.columns
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "col", "value")
    return long.groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))


def solid(vc: DataFrame) -> DataFrame:
    """Without blank values."""
    return vc.where(~is_blank(F.col("value")))


def blank_rates(vc: DataFrame) -> DataFrame:
    """A1: (col, blank_rate, nullable); an empty table gives no rows."""
    blank = F.sum(F.when(is_blank(F.col("value")), F.col("n")).otherwise(0))
    rates = vc.groupBy("col").agg((blank / F.sum("n")).alias("blank_rate"))
    return rates.withColumn("nullable", F.col("blank_rate") > 0)


def _numeric(vc: DataFrame) -> DataFrame:
    return solid(vc).withColumn("v", number(F.col("value")))


def infer_schema(vc: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """A2: (col, dtype, nullable, role). Numeric if nine in ten solid values parse."""
    blank = is_blank(F.col("value"))
    parsed = F.sum(F.when(~blank & number(F.col("value")).isNotNull(), F.col("n")).otherwise(0))
    full = F.sum(F.when(~blank, F.col("n")).otherwise(0))
    found = vc.groupBy("col").agg(parsed.alias("parsed"), full.alias("full"), F.sum("n").alias("rows"))
    role = F.lit("feature")
    for c, r in (roles or {}).items():
        role = F.when(F.col("col") == c, r).otherwise(role)
    numeric = (F.col("full") > 0) & (F.col("parsed") >= F.col("full") * NUMERIC_SHARE)
    return found.select("col", F.when(numeric, "numeric").otherwise("categorical").alias("dtype"), (F.col("full") < F.col("rows")).alias("nullable"), role.alias("role"))


def columns_of_role(df: DataFrame, schema: DataFrame, role: str, dtype: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the columns of ``df`` that ``infer_schema`` gives a role (and dtype), by
    name; the schema has a row per column."""
    wanted = schema.where(F.col("role") == role)
    names = sorted(r["col"] for r in (wanted.where(F.col("dtype") == dtype) if dtype else wanted).select("col").collect())
    return df.select(*keep, *(c for c in names if c not in keep))


def overview(df: DataFrame) -> DataFrame:
    """A3: one row of n_rows, n_columns, duplicate_rows, empty_columns."""
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    full = [F.max((~is_blank(F.col(c).cast("string"))).cast("int")) for c in df.columns]
    empty = sum((F.coalesce(1 - x, F.lit(1)) for x in full), F.lit(0))
    return rows.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
        empty.cast("long").alias("empty_columns"),
    )


def top_values(vc: DataFrame, n: int = 5) -> DataFrame:
    """K1, A4: (col, rank, value, n), most frequent first, then by value."""
    found = top_per(solid(vc), ["col"], [F.desc("n"), F.asc("value")], n, "value")
    return found.select("col", F.col("rank").cast("long").alias("rank"), "value", "n")


def column_profiles(vc: DataFrame) -> DataFrame:
    """A4: (col, null_pct, n_distinct) with the most frequent value."""
    blank = is_blank(F.col("value"))
    base = vc.groupBy("col").agg(
        F.round(100.0 * F.sum(F.when(blank, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("null_pct"),
        F.count(F.when(~blank, 1)).alias("n_distinct"),
    )
    top = top_values(vc, 1).select("col", F.col("value").alias("top_value"), F.col("n").alias("top_n"))
    return base.join(top, "col", "left")


def date_like(vc: DataFrame) -> DataFrame:
    """A10 before its verdict: per column the share of dates and what speaks for each order."""
    t = trimmed(F.col("value"))
    first, second = (F.regexp_extract(t, _NUMERIC_DATE, k).try_cast("int") for k in (1, 2))
    num, txt = t.rlike(_NUMERIC_DATE), t.rlike(_TEXT_DATE)
    n = F.col("n")
    return solid(vc).groupBy("col").agg(
        (F.sum(F.when(num | txt, n).otherwise(0)) / F.sum(n)).alias("date_share"),
        F.max(num.cast("int")).alias("numeric"),
        F.max(txt.cast("int")).alias("text"),
        F.max((num & (first > 12)).cast("int")).alias("day_first"),
        F.max((num & (second > 12)).cast("int")).alias("month_first"),
    )


def date_formats(vc: DataFrame) -> DataFrame:
    """A10: (col, inference) of columns in which seven in ten solid values look like dates.

    A year-first date counts as day-first here; ``timestamp`` reads it year-first all the same.
    """
    day, month = F.col("day_first") == 1, F.col("month_first") == 1
    verdict = (
        F.when((F.col("text") == 1) & (F.col("numeric") == 0), "text_month")
        .when(day & month, "mixed").when(day, "day_first").when(month, "month_first").otherwise("ambiguous")
    )
    return date_like(vc).where(F.col("date_share") >= DATE_SHARE).select("col", verdict.alias("inference"))


def near_duplicates(vc: DataFrame) -> DataFrame:
    """A5: (col, canonical, n_variants, total, variants) of values that only differ in case
    or white space; the most frequent spelling, then the smallest, is canonical. Of many
    variants the first 100 are shown."""
    values = _formed(vc)
    found = _forms(values).where("n_variants > 1")
    own = values.join(found.select("col", "form"), ["col", "form"])
    shown = top_per(own, ["col", "form"], [F.desc("n"), F.asc("value")], SHOWN, "value")
    variants = shown.groupBy("col", "form").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("s"))
    met = found.join(variants, ["col", "form"])
    return met.select("col", "canonical", "n_variants", "total", F.array_join(F.transform("s", lambda x: x["value"]), "|").alias("variants"))


def _formed(vc: DataFrame) -> DataFrame:
    """(col, form, value, n): values with their normal form; no dates."""
    dates = date_like(vc).where(F.col("date_share") >= DATE_SHARE).select("col")
    values = solid(vc).join(F.broadcast(dates), "col", "left_anti")  # a row per column
    return stored(values.select("col", normal_spelling(F.col("value")).alias("form"), "value", "n"), "spellings")


def _forms(values: DataFrame) -> DataFrame:
    """(col, form, canonical, n_variants, total, n): the forms of ``_formed`` values."""
    best = F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("best")
    forms = values.groupBy("col", "form").agg(best, F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("total"))
    return forms.select("col", "form", F.col("best.value").alias("canonical"), "n_variants", "total", (-F.col("best.m")).alias("n"))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: str | Column, b: str | Column) -> Column:
    """V4: the matching-blocks ratio of two texts, first argument first."""
    return F.pandas_udf(_ratio, "double")(a, b)


def spelling_variants(vc: DataFrame, distinct: int = FUZZY_DISTINCT, pairs: int = FUZZY_PAIRS) -> DataFrame:
    """(col, a, b, similarity, canonical): the ``pairs`` pairs a column of forms that look
    alike, in columns of 2 to ``distinct`` forms and at most 0.3 forms a row; others are
    skipped, so that work stays bounded however large the table."""
    return _alike(_forms(_formed(vc)), distinct, pairs)


def _alike(forms: DataFrame, distinct: int = FUZZY_DISTINCT, pairs: int = FUZZY_PAIRS) -> DataFrame:
    fit = forms.groupBy("col").agg(F.count(F.lit(1)).alias("k"), F.sum("total").alias("rows")).where((F.col("k") >= 2) & (F.col("k") <= distinct) & (F.col("k") <= F.col("rows") * FUZZY_SHARE))
    few = forms.join(fit.select("col"), "col", "left_semi").where(F.length("canonical") >= FUZZY_LENGTH)
    found = alike(few.select("col", F.col("canonical").alias("text"), "n"), FUZZY_RATIO, pairs)
    return found.select("col", "a", "b", F.round("similarity", 3).alias("similarity"), F.when(F.col("n_b") > F.col("n_a"), F.col("b")).otherwise(F.col("a")).alias("canonical"))


def alike(texts: DataFrame, ratio: float, most: int, size: int = BLOCK) -> DataFrame:
    """(col, a, b, similarity, n_a, n_b, tried) of the ``most`` pairs a column, a < b, whose
    similarity is ``ratio`` or more, out of ``texts`` (col, text, n).

    Twice the letters that two texts share, over both lengths, is a bound of their
    similarity. Texts are put into blocks by length; blocks whose lengths alone keep the bound
    below ``ratio`` never meet. In two blocks that do, letter counts give the bound of all
    pairs at once, and only pairs that may pass are compared. A pair of blocks gives its own
    best pairs, and ``tried`` is how many it compared.
    """
    known = texts.withColumn("_len", F.length(F.lower("text")))
    placed = ordered_position(known, ["col"], [F.col("_len"), F.col("text")], "_p")
    block = placed.withColumn("block", F.floor((F.col("_p") - 1) / size)).groupBy("col", "block").agg(F.collect_list(F.struct("text", "n")).alias("rows"), F.min("_len").alias("lo"), F.max("_len").alias("hi"))
    blocks = stored(block, "blocks")
    one = blocks.select("col", F.col("block").alias("i"), F.col("rows").alias("x"), F.col("hi").alias("longest"))
    two = blocks.select("col", F.col("block").alias("j"), F.col("rows").alias("y"), F.col("lo").alias("shortest"))
    # Blocks grow in length: the one's longest text against the other's shortest.
    near = (F.col("i") == F.col("j")) | ((F.col("i") < F.col("j")) & (2 * F.col("longest") >= (ratio - 1e-9) * (F.col("longest") + F.col("shortest"))))
    met = one.join(two, "col").where(near).select("col", F.col("i") == F.col("j"), "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                col, same, x, y = (b.column(c)[k].as_py() for c in range(4))
                best, tried = _best_pairs([r["text"] for r in x], [r["text"] for r in y], same, ratio, most)
                count = {r["text"]: r["n"] for r in (*x, *y)}
                rows = [(col, a, c, s, count[a], count[c], tried) for s, a, c in best]
                yield pa.RecordBatch.from_pylist([dict(zip(("col", "a", "b", "similarity", "n_a", "n_b", "tried"), r, strict=True)) for r in rows], _ALIKE)

    pairs = met.mapInArrow(compare, "col string, a string, b string, similarity double, n_a long, n_b long, tried long")
    return top_per(pairs, ["col"], [F.desc("similarity"), F.asc("a"), F.asc("b")], most, "a").drop("rank")


_ALIKE = pa.schema([("col", pa.string()), ("a", pa.string()), ("b", pa.string()), ("similarity", pa.float64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("tried", pa.int64())])


def _best_pairs(x: list[str], y: list[str], same: bool, ratio: float, most: int) -> tuple[list[tuple[float, str, str]], int]:
    """The best pairs of two lists, and how many pairs were compared: those whose shared
    letters, in any order and then in order, leave them a chance."""
    low = {t: t.lower() for t in (*x, *y)}
    letters = {c: i for i, c in enumerate(sorted({c for t in low.values() for c in t}))}
    codes = lambda texts: [np.array([letters[c] for c in low[t]], np.int64) for t in texts]
    p, q = codes(x), codes(y)
    a, b = (np.array([np.bincount(t, minlength=len(letters)) for t in texts], np.int32).reshape(len(texts), len(letters)) for texts in (p, q))
    shared = np.zeros((len(x), len(y)), np.int32)
    for c in range(len(letters)):
        shared += np.minimum.outer(a[:, c], b[:, c])
    may = 2 * shared >= (ratio - 1e-9) * np.add.outer(a.sum(1), b.sum(1))
    i, j = np.nonzero(np.triu(may, 1) if same else may)
    likely = 2 * _in_order(p, q, i, j, len(letters)) >= (ratio - 1e-9) * (a.sum(1)[i] + b.sum(1)[j])
    found, matcher = [], difflib.SequenceMatcher(None)
    tried = [(min(x[k], y[m]), max(x[k], y[m])) for k, m in zip(i[likely], j[likely], strict=True)]
    last = None
    for p, q in sorted(tried, key=lambda t: t[1]):
        if q != last:  # what the matcher keeps of its second text serves all first ones
            matcher.set_seq2(low[q])
            last = q
        matcher.set_seq1(low[p])
        s = matcher.ratio()
        if s >= ratio:
            found.append((s, p, q))
    return sorted(found, key=lambda t: (-t[0], t[1], t[2]))[:most], len(tried)


def _in_order(p: list[np.ndarray], q: list[np.ndarray], i: np.ndarray, j: np.ndarray, n_letters: int) -> np.ndarray:
    """The longest common subsequence of each pair (p[i], q[j]), which no sum of matching
    blocks exceeds: a bit a letter of the first text, over the letters of the second. Of texts
    beyond 64 letters, the shorter one's length."""
    one, two = np.array([len(t) for t in p], np.int64), np.array([len(t) for t in q], np.int64)
    out = np.minimum(one[i], two[j])
    fits = one[i] <= 64
    i, j = i[fits], j[fits]
    if not len(i):
        return out
    masks = np.zeros((len(p), n_letters + 1), np.uint64)  # the last column is of no letter
    for k, t in enumerate(p):
        if len(t) <= 64:
            np.bitwise_or.at(masks[k], t, np.left_shift(np.uint64(1), np.arange(len(t), dtype=np.uint64)))
    padded = np.full((len(q), int(two[j].max())), n_letters)
    for k, t in enumerate(q):
        padded[k, : len(t)] = t[: padded.shape[1]]
    row = np.full(len(i), 2**64 - 1, np.uint64)
    for at in range(padded.shape[1]):
        met = row & masks[i, padded[j, at]]
        row = (row + met) | (row - met)
    own = np.where(one[i] == 64, np.uint64(2**64 - 1), np.left_shift(np.uint64(1), np.minimum(one[i], 63).astype(np.uint64)) - np.uint64(1))
    out[fits] = np.bitwise_count(~row & own)
    return out


def merge_suggestions(vc: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(col, variant, canonical, confirmed): spellings of one form are confirmed."""
    values = _formed(vc)
    forms = _forms(values)
    exact = values.join(forms.where("n_variants > 1").select("col", "form", "canonical"), ["col", "form"])
    out = exact.where("value <> canonical").select("col", F.col("value").alias("variant"), "canonical", F.lit(True).alias("confirmed"))
    if fuzzy:
        pairs = _alike(forms).select("col", F.when(F.col("canonical") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("variant"), "canonical", F.lit(False).alias("confirmed"))
        out = out.unionByName(pairs)
    return out


def literal_sentinels(vc: DataFrame) -> DataFrame:
    """(col, sentinel, count, fraction, other_min, other_max) for 0 and -1."""
    v = _numeric(vc).where("v is not null")
    sent = F.explode(F.array(F.lit(0.0), F.lit(-1.0))).alias("sentinel")
    hit = F.col("v") == F.col("sentinel")
    # One pass: the values' own table, twice as long.
    found = v.select("col", "v", "n", sent).groupBy("col", "sentinel").agg(
        F.sum("n").alias("rows"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("count"),
        F.min(F.when(~hit, F.col("v"))).alias("other_min"), F.max(F.when(~hit, F.col("v"))).alias("other_max"),
    )
    share = F.col("count") / F.col("rows")
    kept = found.where((F.col("rows") >= SENTINEL_ROWS) & (share >= SENTINEL_SHARE) & (share < 1))
    return kept.select("col", "sentinel", "count", share.alias("fraction"), "other_min", "other_max")


def low_clusters(vc: DataFrame) -> DataFrame:
    """(col, low_max, high_min, count, fraction): values below the widest gap.

    Neighbours are found inside ranges of values, and across the ranges' ends from one
    row per range, so that a column of any length is spread over tasks.
    """
    values = stored(_numeric(vc).where("v is not null").groupBy("col", "v").agg(F.sum("n").alias("n")), "values")
    placed = ranged(values, ["col"], [F.col("v")])
    inside = Window.partitionBy("col", "_pid").orderBy("v")
    gaps = placed.select("col", F.col("v").alias("low"), F.lead("v").over(inside).alias("high"))
    ends = placed.groupBy("col", "_pid").agg(F.min("v").alias("first"), F.max("v").alias("last"))
    across = ends.select("col", F.col("last").alias("low"), F.lead("first").over(Window.partitionBy("col").orderBy("_pid")).alias("high"))
    widest = (
        gaps.unionByName(across).where("high is not null").groupBy("col")
        .agg(F.max(F.struct((F.col("high") - F.col("low")).alias("gap"), (-F.col("low")).alias("m"), "high")).alias("w"))
        .select("col", "w.gap", (-F.col("w.m")).alias("low_max"), F.col("w.high").alias("high_min"))
    )
    met = values.join(F.broadcast(widest), "col")  # a row per column
    found = met.groupBy("col", "gap", "low_max", "high_min").agg(
        F.count(F.lit(1)).alias("k"), (F.max("v") - F.min("v")).alias("span"), F.sum("n").alias("rows"),
        F.sum(F.when(F.col("v") <= F.col("low_max"), F.col("n")).otherwise(0)).alias("count"),
    )
    share = F.col("count") / F.col("rows")
    kept = found.where((F.col("k") >= 3) & (F.col("rows") >= SENTINEL_ROWS) & (F.col("gap") >= F.col("span") * CLUSTER_GAP) & share.between(CLUSTER_LOW, CLUSTER_HIGH))
    return kept.select("col", "low_max", "high_min", "count", share.alias("fraction"))


def float_identifiers(vc: DataFrame) -> DataFrame:
    """(col, fraction) of columns where half of the solid values are long whole numbers with ``.0``."""
    hit = trimmed(F.col("value")).rlike(r"^[0-9]{5,}[.]0$")
    found = solid(vc).groupBy("col").agg((F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).alias("fraction"))
    return found.where(F.col("fraction") >= FLOAT_ID_SHARE)


def components_of(c: Column, delimiter: str) -> Column:
    """The non-empty trimmed parts of a multi-valued cell, in order."""
    parts = F.transform(F.split(c, "\\Q" + delimiter + "\\E", -1), trimmed)
    return F.filter(parts, lambda x: x != "")


def multi_valued(vc: DataFrame) -> DataFrame:
    """(col, delimiter, fraction, n_components, order_varies) with the first delimiter
    that gives one cell in twenty several parts."""
    cuts = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(d).alias("delimiter"), components_of(F.col("value"), d).alias("parts")) for k, d in enumerate(DELIMITERS)))
    # One pass over the cells; only those of several parts are kept.
    cells = solid(vc).select("col", "n", F.filter(cuts, lambda x: F.size(x["parts"]) >= 2).alias("cuts"))
    rows = cells.groupBy("col").agg(F.sum("n").alias("rows"))
    many = stored(cells.select("col", "n", F.explode("cuts").alias("x")).select("col", "n", "x.k", "x.delimiter", "x.parts"), "multi-valued")
    share = many.groupBy("col", "k", "delimiter").agg(F.sum("n").alias("got")).join(rows, "col").select("col", "k", "delimiter", (F.col("got") / F.col("rows")).alias("fraction"))
    first = share.where(F.col("fraction") >= MULTI_SHARE).groupBy("col").agg(F.min(F.struct("k", "delimiter", "fraction")).alias("m"))
    chosen = stored(first.select("col", "m.k", "m.delimiter", "m.fraction"), "multi-chosen")
    cut = many.join(F.broadcast(chosen.select("col", "k")), ["col", "k"], "left_semi")  # a row per column
    parts = cut.select("col", F.explode("parts").alias("p")).groupBy("col").agg(F.countDistinct("p").alias("n_components"))
    sets = cut.groupBy("col", F.array_sort("parts").alias("s")).agg(F.min("parts").alias("lo"), F.max("parts").alias("hi"))
    varies = sets.groupBy("col").agg(F.max(F.col("lo") < F.col("hi")).alias("order_varies"))
    return chosen.join(parts, "col").join(varies, "col").select("col", "delimiter", "fraction", "n_components", "order_varies")


def free_text(vc: DataFrame) -> DataFrame:
    """(col, rows, n_distinct, distinct_ratio, singleton_ratio)."""
    found = solid(vc).groupBy("col").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("n_distinct"), F.count(F.when(F.col("n") == 1, 1)).alias("single"))
    distinct, single = F.col("n_distinct") / F.col("rows"), F.col("single") / F.col("n_distinct")
    kept = found.where((F.col("rows") >= FREE_ROWS) & (distinct >= FREE_DISTINCT) & (single >= FREE_SINGLE))
    return kept.select("col", "rows", "n_distinct", distinct.alias("distinct_ratio"), single.alias("singleton_ratio"))


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, v, n): how often each column has each number. Columns of numbers are counted as
    such; only text is parsed, once per different text. Nulls and NaN are left out."""
    kinds = dict(df.dtypes)
    text = [c for c in columns if kinds[c] == "string"]
    out = None
    if len(text) < len(columns):
        own = [c for c in columns if c not in text]
        long = df.select(*(F.col(c).cast("double").alias(c) for c in own)).unpivot([], own, "col", "v")
        out = long.where("v is not null and not isnan(v)").groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))
    if text:
        parsed = _parsed(value_counts(df, text))
        out = parsed if out is None else out.unionByName(parsed)
    return out


def _parsed(vc: DataFrame) -> DataFrame:
    return _numeric(vc).where("v is not null and not isnan(v)").groupBy("col", "v").agg(F.sum("n").alias("n"))


def numeric_distribution(vc: DataFrame) -> DataFrame:
    """``distribution`` of the values that parse."""
    return distribution(_parsed(vc))


def distribution(values: DataFrame) -> DataFrame:
    """(col, metric, value) of (col, v, n): count, min, max, mean, std (0 for one value)
    and percentiles; a column of any length is spread over tasks."""
    v = stored(values, "values")
    n = F.sum("n")
    mean = F.sum(F.col("v") * F.col("n")) / n
    base = v.groupBy("col").agg(n.cast("double").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), mean.alias("mean"))
    base = stored(base, "numeric-base")  # a row per column
    dev = v.join(F.broadcast(base.select("col", "mean")), "col")
    std = dev.groupBy("col").agg(F.coalesce(F.sqrt(F.try_divide(F.sum(F.col("n") * (F.col("v") - F.col("mean")) ** 2), F.sum("n") - 1)), F.lit(0.0)).alias("std"))
    wide = base.join(std, "col")
    flat = wide.unpivot(["col"], ["count", "min", "max", "mean", "std"], "metric", "value")
    q = quantiles(v, ["col"], "v", "n", PERCENTILES)
    names = F.concat(F.lit("p"), F.round(F.col("point") * 100).cast("int").cast("string"))
    return flat.unionByName(q.select("col", names.alias("metric"), F.col("quantile").alias("value")))


def histogram(vc: DataFrame, n_bins: int = 30) -> DataFrame:
    """(col, bin, n) of equal-width bins, the last closed; one value widens to +-0.5."""
    return bins(_parsed(vc), n_bins)


def bins(v: DataFrame, n_bins: int = 30) -> DataFrame:
    """``histogram`` of (col, v, n)."""
    v = stored(v, "values")
    ends = v.groupBy("col").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    ends = ends.select("col", F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    met = v.join(F.broadcast(ends), "col")  # a row per column
    k = F.least(F.floor((F.col("v") - F.col("lo")) * n_bins / (F.col("hi") - F.col("lo"))), F.lit(n_bins - 1))
    return met.groupBy("col", k.cast("long").alias("bin")).agg(F.sum("n").alias("n"))


def categorical_distribution(vc: DataFrame, top: int = 30) -> DataFrame:
    """(col, rank, value, n); rank 0 holds the rest: its rows, and its values as text."""
    best = top_values(vc, top)
    all_ = solid(vc).groupBy("col").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values"))
    taken = best.groupBy("col").agg(F.sum("n").alias("got"), F.count(F.lit(1)).alias("k"))
    rest = all_.join(taken, "col").where("values > k").select("col", F.lit(0).cast("long").alias("rank"), (F.col("values") - F.col("k")).cast("string").alias("value"), (F.col("rows") - F.col("got")).alias("n"))
    return best.unionByName(rest)


def date_distribution(vc: DataFrame) -> DataFrame:
    """(col, day, n) of columns whose date format is known."""
    known = date_formats(vc).where("inference in ('day_first', 'month_first', 'text_month')")
    met = solid(vc).join(F.broadcast(known), "col")  # a row per column
    ts = F.when(F.col("inference") == "month_first", timestamp(F.col("value"), False)).otherwise(timestamp(F.col("value"), True))
    return met.groupBy("col", F.to_date(ts).alias("day")).agg(F.sum("n").alias("n")).where("day is not null")


def fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, hash): the same for the same rows in any order."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns]
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cells)), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("decimal(38,0)").cast("string").alias("hash"))


def outcome(vc: DataFrame, column: str) -> DataFrame:
    """(value, n, ordinal): ordinal if there are 2 to 8 levels; by falling count."""
    own = solid(vc).where(F.col("col") == column).select("value", "n")
    k = own.agg(F.count(F.lit(1)).alias("k"))
    return own.crossJoin(F.broadcast(k)).select("value", "n", F.col("k").between(2, 8).alias("ordinal"))  # one row


def full_profile(df: DataFrame) -> DataFrame:
    """(section, col, metric, value): all findings as one long table of text."""
    vc = stored(value_counts(df), "value-counts")
    parts = {
        "schema": infer_schema(vc), "blanks": blank_rates(vc), "columns": column_profiles(vc), "dates": date_formats(vc),
        "near_duplicates": near_duplicates(vc).drop("variants"), "sentinels": literal_sentinels(vc), "clusters": low_clusters(vc),
        "float_ids": float_identifiers(vc), "multi_valued": multi_valued(vc), "free_text": free_text(vc),
    }
    long = []
    for section, found in parts.items():
        names = [c for c in found.columns if c != "col"]
        texts = found.select("col", *(F.col(c).cast("string").alias(c) for c in names))
        long.append(texts.unpivot(["col"], names, "metric", "value").select(F.lit(section).alias("section"), "col", "metric", "value"))
    out = long[0]
    for x in long[1:]:
        out = out.unionByName(x)
    return out
