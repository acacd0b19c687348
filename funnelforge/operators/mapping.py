"""Mapping messy files to canonical fields, and checks of the result."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelforge.functions.scalars import is_blank, number, phone, timestamp
from funnelforge.operators import profile
from funnelforge.operators.position import top_per
from funnelforge.session import stored

#: Least ratio of a suggestion, and what an exact alias is worth.
SUGGEST, EXACT = 0.55, 0.95
PHONE_RATE = 0.90
EXAMPLES = 10


def apply_mapping(df: DataFrame, fields: dict[str, list[str]], extra: str = "extra__") -> DataFrame:
    """Each field is the first solid value of its columns, else the last column's raw
    value; columns that no field uses are kept under ``extra``."""
    used = {c for cols in fields.values() for c in cols}
    out = [F.coalesce(*(F.when(~is_blank(F.col(c)), F.col(c)) for c in cols[:-1]), F.col(cols[-1])).alias(f) for f, cols in fields.items() if cols]
    return df.select(*out, *(F.col(c).alias(extra + c) for c in df.columns if c not in used))


def plain_name(c: Column) -> Column:
    """A column name without case and signs."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def column_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, other, kind) of two one-column tables ``column``: unchanged, renamed (the
    same plain name, in order), added, removed. Names are few per table."""
    both = before.join(after, "column", "inner").select("column", F.col("column").alias("other"), F.lit("unchanged").alias("kind"))
    gone = before.join(after, "column", "left_anti").withColumn("plain", plain_name(F.col("column")))
    new = after.join(before, "column", "left_anti").withColumn("plain", plain_name(F.col("column")))
    w = Window.partitionBy("plain").orderBy("column")
    met = gone.withColumn("k", F.row_number().over(w)).join(new.withColumn("k", F.row_number().over(w)).withColumnRenamed("column", "other"), ["plain", "k"], "full")
    kind = F.when(F.col("other").isNull(), "removed").when(F.col("column").isNull(), "added").otherwise("renamed")
    return both.unionByName(met.select("column", "other", kind.alias("kind")))


def suggest_mapping(columns: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """(file, field, rank, column, confidence): for each file and canonical field, the
    file's columns whose names look like the field's or an alias of it, best first.

    ``columns``: (file, column). ``aliases``: the other names of each field, a vocabulary of
    some dozens that goes along with the plan; each distinct plain name is compared once.
    """
    names = columns.withColumn("plain", plain_name(F.col("column")))
    strip = lambda x: "".join(ch for ch in x.lower() if ch.isascii() and ch.isalnum())
    known = sorted({(f, strip(a)) for f, more in aliases.items() for a in [f, *more]})
    vocabulary = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(a).alias("alias")) for f, a in known))).alias("v")
    tried = names.select("plain").where("plain <> ''").distinct().select("plain", vocabulary).select("plain", "v.field", "v.alias")
    score = F.when(F.col("plain") == F.col("alias"), F.lit(EXACT)).otherwise(profile.similarity("plain", "alias"))
    best = tried.withColumn("confidence", score).groupBy("plain", "field").agg(F.max("confidence").alias("confidence")).where(F.col("confidence") >= SUGGEST)
    found = names.join(best, "plain").select("file", "field", "column", F.round("confidence", 3).alias("confidence"))
    # A file has some dozens of columns.
    w = Window.partitionBy("file", "field").orderBy(F.desc("confidence"), "column")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).select("file", "field", "rank", "column", "confidence")


def validate_canonical(df: DataFrame, required: list[str], unique: list[str], phone_col: str, created_col: str, disposition_col: str, day_first: bool = True) -> DataFrame:
    """(kind, field, n, total): blanks of required fields, values of unique fields that
    repeat, phones and dates that parse, and counts of each disposition."""
    solid = lambda c: ~is_blank(F.col(c))
    count = lambda cond: F.count(F.when(cond, 1))
    checks = [("missing", f, count(~solid(f)), F.count(F.lit(1))) for f in required]
    checks.append(("phone_normalized", phone_col, count(solid(phone_col) & phone(F.col(phone_col)).isNotNull()), count(solid(phone_col))))
    checks.append(("date_parsed", created_col, count(solid(created_col) & timestamp(F.col(created_col), day_first).isNotNull()), count(solid(created_col))))
    one = df.agg(*(n.alias(f"n{i}") for i, (_, _, n, _) in enumerate(checks)), *(t.alias(f"t{i}") for i, (_, _, _, t) in enumerate(checks)))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(f).alias("field"), F.col(f"n{i}").alias("n"), F.col(f"t{i}").alias("total")) for i, (k, f, _, _) in enumerate(checks))))
    out = one.select(rows.alias("x")).select("x.*")
    for f in unique:
        per = df.where(solid(f)).groupBy(f).agg(F.count(F.lit(1)).alias("k"))
        out = out.unionByName(per.agg(F.lit("duplicate").alias("kind"), F.lit(f).alias("field"), F.count(F.when(F.col("k") > 1, 1)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("total")))
    levels = df.where(solid(disposition_col)).groupBy(disposition_col).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(levels.select(F.lit("disposition").alias("kind"), F.col(disposition_col).alias("field"), "n", F.lit(None).cast("long").alias("total")))


@dataclass(frozen=True)
class Field:
    """A canonical field: whether it must be mapped (always, for training, or not), and
    whether its values must differ."""

    name: str
    required: str = "no"
    unique: bool = False


SEVERITY = {
    "missing_required_field": "error", "duplicate_value": "error", "low_phone_match_rate": "error", "ambiguous_date_needs_confirmation": "error", "unparsed_created_at": "warning",
}


def canonical_issues(df: DataFrame, fields: list[Field], training: bool, phone_col: str = "phone", created_col: str = "created_at", day_first: bool | None = None, least_phones: float = PHONE_RATE) -> DataFrame:
    """(kind, field, severity, n, total, examples): what keeps a mapped table from being
    used, errors first to be mended, and what only deserves a look.

    Required fields without a column (n and total 0); unique fields by values that repeat and
    their rows; phones if fewer than ``least_phones`` of the solid ones normalise, with ten
    that do not; dates that could be day-first or month-first, unless ``day_first`` says which;
    dates that do not parse. Two aggregations read the table, and one per unique field.
    """
    spark = df.sparkSession
    schema = "kind string, field string, n long, total long, examples string"
    lacking = [f.name for f in fields if f.name not in df.columns and (f.required == "always" or (f.required == "train" and training))]
    parts = [spark.createDataFrame([("missing_required_field", name, 0, 0, "") for name in lacking], schema)]
    solid = lambda c: ~is_blank(F.col(c).cast("string"))
    for f in fields:
        if f.unique and f.name in df.columns:
            again = df.where(solid(f.name)).groupBy(f.name).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
            parts.append(again.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("total")).where("n > 0").select(F.lit("duplicate_value").alias("kind"), F.lit(f.name).alias("field"), "n", "total", F.lit("").alias("examples")))
    if phone_col in df.columns:
        rows = df.where(solid(phone_col)).select(F.col(phone_col).cast("string").alias("value"))
        bad = rows.where(phone(F.col("value")).isNull())
        few = bad.distinct().orderBy("value").limit(EXAMPLES).agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("examples"))
        rate = rows.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(phone(F.col("value")).isNull(), 1)).alias("n")).where((F.col("total") > 0) & (F.col("total") - F.col("n") < least_phones * F.col("total")))
        parts.append(rate.crossJoin(F.broadcast(few)).select(F.lit("low_phone_match_rate").alias("kind"), F.lit(phone_col).alias("field"), "n", "total", "examples"))  # one row
    if created_col in df.columns:
        vc = stored(profile.value_counts(df, [created_col]), "dates")
        unclear = profile.date_formats(vc).where(F.lit(day_first is None) & (F.col("inference") == "ambiguous"))
        parts.append(unclear.select(F.lit("ambiguous_date_needs_confirmation").alias("kind"), F.col("col").alias("field"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), F.lit("").alias("examples")))
        read = timestamp(F.col("value"), True if day_first is None else day_first)
        counted = profile.solid(vc).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(read.isNull(), F.col("n"))), F.lit(0)).alias("n")).where("n > 0")
        asked = counted.join(F.broadcast(unclear.select(F.lit(1).alias("one"))), F.lit(True), "left_anti")  # a row at most
        parts.append(asked.select(F.lit("unparsed_created_at").alias("kind"), F.lit(created_col).alias("field"), "n", "total", F.lit("").alias("examples")))
    out = reduce(DataFrame.unionByName, parts)
    severity = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    return out.select("kind", "field", severity[F.col("kind")].alias("severity"), "n", "total", "examples")


def compare_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, before_n, after_n) of two tables of findings (kind)."""
    a = before.groupBy("kind").agg(F.count(F.lit(1)).alias("before_n"))
    b = after.groupBy("kind").agg(F.count(F.lit(1)).alias("after_n"))
    return a.join(b, "kind", "full").select("kind", F.coalesce("before_n", F.lit(0)).alias("before_n"), F.coalesce("after_n", F.lit(0)).alias("after_n"))


def findings(df: DataFrame) -> DataFrame:
    """(kind, col): one row per finding of six types; the table is counted once."""
    vc = stored(profile.value_counts(df), "value-counts")
    parts = {
        "near_duplicate": profile.near_duplicates(vc), "sentinel": profile.literal_sentinels(vc), "date_format": profile.date_formats(vc),
        "float_identifier": profile.float_identifiers(vc), "multi_valued": profile.multi_valued(vc), "free_text": profile.free_text(vc),
    }
    out = None
    for kind, found in parts.items():
        one = found.select(F.lit(kind).alias("kind"), "col")
        out = one if out is None else out.unionByName(one)
    return out


def schema_drift(actual: DataFrame, pinned: DataFrame) -> DataFrame:
    """(col, kind) of two schema tables (col, dtype, nullable)."""
    a = actual.select("col", F.col("dtype").alias("a_dtype"), F.col("nullable").alias("a_null"))
    p = pinned.select("col", F.col("dtype").alias("p_dtype"), F.col("nullable").alias("p_null"))
    met = a.join(p, "col", "full")
    missing, new = F.col("a_dtype").isNull(), F.col("p_dtype").isNull()
    both = ~missing & ~new
    kinds = F.array_compact(
        F.array(
            F.when(missing, "missing_column"), F.when(new, "unexpected_column"), F.when(both & (F.col("a_dtype") != F.col("p_dtype")), "dtype_mismatch"),
            F.when(both & F.col("a_null") & ~F.col("p_null"), "null_violation"),
        )
    )
    return met.select("col", F.explode(kinds).alias("kind"))


def null_shift(batch: DataFrame, pinned: DataFrame, limit: float = 0.20) -> DataFrame:
    """(col, batch_rate, pinned_rate) where the share of blanks moved by over 20 points.
    Both are (col, blank_rate) tables."""
    met = batch.select("col", F.col("blank_rate").alias("batch_rate")).join(pinned.select("col", F.col("blank_rate").alias("pinned_rate")), "col")
    return met.where(F.abs(F.col("batch_rate") - F.col("pinned_rate")) > limit)


def not_coercible(vc: DataFrame, numeric: list[str], examples: int = 10) -> DataFrame:
    """(col, n, examples) of values of numeric columns that do not parse."""
    bad = profile.solid(vc).where(F.col("col").isin(numeric) & number(F.col("value")).isNull())
    total = bad.groupBy("col").agg(F.sum("n").alias("n"))
    first = top_per(bad, ["col"], [F.asc("value")], examples, "value")
    few = first.groupBy("col").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("examples"))
    return total.join(few, "col")


def vocabulary(vc: DataFrame, columns: list[str]) -> DataFrame:
    """(col, value): the solid values of categorical columns."""
    return profile.solid(vc).where(F.col("col").isin(columns)).select("col", "value")


def unseen_categories(vc: DataFrame, vocab: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """(col, value, n, rank): the most frequent values that the vocabulary lacks."""
    new = profile.solid(vc).where(F.col("col").isin(columns)).join(vocab, ["col", "value"], "left_anti")
    return top_per(new, ["col"], [F.desc("n"), F.asc("value")], top, "value").select("col", "value", "n", F.col("rank").cast("long").alias("rank"))


PINNED = "col string, value string, rate double"


def pins(vc: DataFrame, features: dict[str, str]) -> DataFrame:
    """(col, value, rate): what a training table's counts pin for later batches: a row for
    each solid value of a categorical feature, and one for each feature's share of blanks."""
    known = vc.where(F.col("col").isin(list(features)))
    rest = [c for c, d in features.items() if d != "numeric"]
    values = profile.solid(known).where(F.col("col").isin(rest)).select("col", "value", F.lit(None).cast("double").alias("rate"))
    rates = profile.blank_rates(known).select("col", F.lit(None).cast("string").alias("value"), F.col("blank_rate").alias("rate"))
    return values.unionByName(rates)


def preflight(vc: DataFrame, features: dict[str, str], pinned: DataFrame, shift: float = 0.20) -> DataFrame:
    """(col, kind, severity, n): what is wrong with a batch before it is scored.

    ``features``: dtype by column; ``pinned``: ``pins`` of the training table. Missing features
    and values that do not parse are errors; unseen categories and moved shares of blanks are
    warnings. The batch's counts, the pinned rows and the features are one long table, added
    up by value and then by column, so each is read once.
    """
    spark = vc.sparkSession
    wanted = spark.createDataFrame(list(features.items()), "col string, dtype string")
    none = lambda kind: F.lit(None).cast(kind)
    long = (
        vc.where(F.col("col").isin(list(features))).select("col", "value", "n", none("double").alias("rate"), F.lit(0).alias("known"), none("string").alias("dtype"))
        .unionByName(pinned.where(F.col("col").isin(list(features))).select("col", "value", F.lit(0).cast("long").alias("n"), "rate", F.col("value").isNotNull().cast("int").alias("known"), none("string").alias("dtype")))
        .unionByName(wanted.select("col", none("string").alias("value"), F.lit(0).cast("long").alias("n"), none("double").alias("rate"), F.lit(0).alias("known"), "dtype"))
    )
    values = long.groupBy("col", "value").agg(F.sum("n").alias("n"), F.max("rate").alias("rate"), F.max("known").alias("known"), F.max("dtype").alias("dtype"))
    blank, n = is_blank(F.col("value")), F.col("n")
    part = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    per = values.groupBy("col").agg(
        F.max("dtype").alias("dtype"), F.sum("n").alias("rows"), part(blank).alias("blank"), F.max("rate").alias("rate"),
        part(~blank & number(F.col("value")).isNull()).alias("no_number"), part(~blank & (F.col("known") == 0)).alias("unseen"),
    )
    numeric, present = F.col("dtype") == "numeric", F.col("rows") > 0
    moved = F.abs(F.try_divide("blank", "rows") - F.col("rate")) > shift
    issue = lambda cond, kind, severity, count: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), count.cast("long").alias("n")))
    found = F.array(
        issue(~present, "missing_feature", "error", F.lit(0)), issue(present & numeric & (F.col("no_number") > 0), "not_coercible", "error", F.col("no_number")),
        issue(present & ~numeric & (F.col("unseen") > 0), "unseen_category", "warning", F.col("unseen")), issue(present & moved, "null_shift", "warning", F.lit(0)),
    )
    return per.select("col", F.explode(F.array_compact(found)).alias("i")).select("col", "i.kind", "i.severity", "i.n")


def verdict(report: DataFrame) -> DataFrame:
    """One row of n_errors, n_warnings and whether the batch may be scored."""
    n = lambda severity: F.count(F.when(F.col("severity") == severity, 1))
    return report.agg(n("error").alias("n_errors"), n("warning").alias("n_warnings")).withColumn("scoreable", F.col("n_errors") == 0)
