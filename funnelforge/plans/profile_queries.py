"""Queries of the profiling operators over the lead table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelforge.operators import profile as P
from funnelforge.plans.tables import LEAD_COLUMNS, LEADS_SQL, VC_SQL, leads, table


def _vc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.value_counts(leads(spark, sf_dir), list(LEAD_COLUMNS))


def vc_value_counts(spark, sf_dir):
    return _vc(spark, sf_dir)


def a1_blank_rates(spark, sf_dir):
    return P.blank_rates(_vc(spark, sf_dir))


def a2_infer_schema(spark, sf_dir):
    return P.infer_schema(_vc(spark, sf_dir), {"lead_id": "id", "disposition": "target"})


def a3_overview(spark, sf_dir):
    return P.overview(table(spark, sf_dir, "lineitem"))


def a4_column_profiles(spark, sf_dir):
    return P.column_profiles(_vc(spark, sf_dir))


def k1_top_values(spark, sf_dir):
    return P.top_values(_vc(spark, sf_dir))


def a5_near_duplicates(spark, sf_dir):
    return P.near_duplicates(_vc(spark, sf_dir))


def a6_spelling_variants(spark, sf_dir):
    return P.spelling_variants(_vc(spark, sf_dir))


def j10_alike_names(spark, sf_dir):
    """Forms of part names and types that look alike, with a limit of 2,000 forms."""
    rows = table(spark, sf_dir, "part").select("p_name", "p_type")
    return P.spelling_variants(P.value_counts(rows), 2000, 60)


def a7_merge_suggestions(spark, sf_dir):
    return P.merge_suggestions(_vc(spark, sf_dir), fuzzy=False)


def a7_fuzzy_merges(spark, sf_dir):
    """Merges that also hold names which only look alike, over part names."""
    parts = table(spark, sf_dir, "part").select("p_name", "p_type", "p_brand")
    return P.merge_suggestions(P.value_counts(parts))


def a8_literal_sentinels(spark, sf_dir):
    return P.literal_sentinels(_vc(spark, sf_dir))


def a9_low_clusters(spark, sf_dir):
    return P.low_clusters(_vc(spark, sf_dir))


def a10_date_formats(spark, sf_dir):
    return P.date_formats(_vc(spark, sf_dir))


def a11_float_identifiers(spark, sf_dir):
    return P.float_identifiers(_vc(spark, sf_dir))


def a12_multi_valued(spark, sf_dir):
    return P.multi_valued(_vc(spark, sf_dir))


def a13_free_text(spark, sf_dir):
    return P.free_text(_vc(spark, sf_dir))


def a14_numeric_distribution(spark, sf_dir):
    found = P.distribution(P.numbers(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))
    return found.select("col", "metric", F.round("value", 4).alias("value"))


def a14_text_distribution(spark, sf_dir):
    """The same of text that holds numbers and other things."""
    return P.numeric_distribution(_vc(spark, sf_dir).where("col in ('score', 'balance', 'tenure')")).select("col", "metric", F.round("value", 4).alias("value"))


def a14_histogram(spark, sf_dir):
    return P.bins(P.numbers(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_suppkey"]))


def a15_categorical_distribution(spark, sf_dir):
    return P.categorical_distribution(_vc(spark, sf_dir), 3)


def a16_date_distribution(spark, sf_dir):
    return P.date_distribution(_vc(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


def a17_fingerprint(spark, sf_dir):
    return P.fingerprint(leads(spark, sf_dir))


def a18_outcome(spark, sf_dir):
    return P.outcome(_vc(spark, sf_dir), "disposition")


def s13_full_profile(spark, sf_dir):
    """All findings as text; numbers are written with six places."""
    found = P.full_profile(leads(spark, sf_dir))
    n = F.round(F.col("value").try_cast("double"), 6).try_cast("decimal(30,6)").cast("string")
    return found.withColumn("value", F.coalesce(n, "value"))


QUERIES = [
    vc_value_counts, a1_blank_rates, a2_infer_schema, a3_overview, a4_column_profiles, k1_top_values, a5_near_duplicates, a6_spelling_variants, j10_alike_names,
    a7_merge_suggestions, a7_fuzzy_merges, a8_literal_sentinels, a9_low_clusters, a10_date_formats, a11_float_identifiers, a12_multi_valued, a13_free_text,
    a14_numeric_distribution, a14_text_distribution, a14_histogram, a15_categorical_distribution, a16_date_distribution, a17_fingerprint, a18_outcome, s13_full_profile,
]

#: A number as the operators read it.
NUMBER = r"^\s*[+-]?(([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
_BLANK = r"(value IS NULL OR regexp_full_match(value, '\s*'))"
_V = f"CASE WHEN regexp_matches(value, '{NUMBER}') THEN TRY_CAST(trim(value) AS DOUBLE) END"
_NUM = VC_SQL + f", num AS (SELECT col, {_V} AS v, n FROM solid)"
_TOP = "row_number() OVER (PARTITION BY col ORDER BY n DESC, value)"
_DATE = r"'^([0-9]{1,4})[/\-.]([0-9]{1,4})[/\-.]([0-9]{1,4})$'"
_TXT = r"'(?i)^[0-9]{1,2}\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+[0-9]{2,4}$'"
_DATES = f""", d AS (SELECT col, n, regexp_matches(trim(value), {_DATE}) AS num, regexp_matches(trim(value), {_TXT}) AS txt,
  TRY_CAST(regexp_extract(trim(value), {_DATE}, 1) AS INTEGER) AS c1, TRY_CAST(regexp_extract(trim(value), {_DATE}, 2) AS INTEGER) AS c2 FROM solid),
  dates AS (SELECT col, CASE WHEN bool_or(txt) AND NOT bool_or(num) THEN 'text_month' WHEN bool_or(num AND c1 > 12) AND bool_or(num AND c2 > 12) THEN 'mixed'
    WHEN bool_or(num AND c1 > 12) THEN 'day_first' WHEN bool_or(num AND c2 > 12) THEN 'month_first' ELSE 'ambiguous' END AS inference
  FROM d GROUP BY col HAVING sum(CASE WHEN num OR txt THEN n ELSE 0 END) >= 0.7 * sum(n))"""
_FORMS = (
    _DATES
    + r""", forms AS (SELECT col, regexp_replace(trim(lower(value)), '\s+', ' ', 'g') AS form, value, n FROM solid WHERE col NOT IN (SELECT col FROM dates)),
  groups AS (SELECT col, form, first(value ORDER BY n DESC, value) AS canonical, count(*) AS n_variants, CAST(sum(n) AS BIGINT) AS total,
    string_agg(value, '|' ORDER BY n DESC, value) AS variants FROM forms GROUP BY 1, 2)"""
)
_MULTI = r""", cells AS (SELECT col, n, k, delim, list_filter(list_transform(string_split(value, delim), lambda x: trim(x)), lambda x: x <> '') AS parts
  FROM solid, (VALUES (0, ';'), (1, '|'), (2, ',')) AS q(k, delim)),
  share AS (SELECT col, k, delim, sum(CASE WHEN len(parts) >= 2 THEN n ELSE 0 END) / sum(n) AS fraction FROM cells GROUP BY 1, 2, 3),
  chosen AS (SELECT col, min(k) AS k FROM share WHERE fraction >= 0.05 GROUP BY 1),
  cut AS (SELECT cells.* FROM cells JOIN chosen USING (col, k) WHERE len(parts) >= 2),
  parts AS (SELECT col, count(DISTINCT p) AS n_components FROM (SELECT col, unnest(parts) AS p FROM cut) GROUP BY 1),
  varies AS (SELECT col, bool_or(k > 1) AS order_varies FROM (SELECT col, count(DISTINCT parts) AS k FROM cut GROUP BY col, list_sort(parts)) GROUP BY 1)"""
#: How alike two texts are: the longest block of letters that they share, the first where
#: several are as long, then the same left and right of it, until nothing is shared.
_BLOCK = """list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(y) + 1), lambda j:
  1000000 * len(list_filter(range(1, least(length(x) - i, length(y) - j) + 2), lambda q: substr(x, i, q) = substr(y, j, q))) + 1000 * (1000 - i) + 1000 - j))))"""
RATIO_SQL = f""", blocks AS (
  SELECT a, b, a AS x, b AS y, CAST(0 AS BIGINT) AS k FROM (SELECT DISTINCT lower(a) AS a, lower(b) AS b FROM tried)
  UNION ALL
  SELECT a, b, unnest([substr(x, 1, i - 1), substr(x, i + k)]), unnest([substr(y, 1, j - 1), substr(y, j + k)]), unnest([k, 0])
  FROM (SELECT a, b, x, y, m // 1000000 AS k, 1000 - m // 1000 % 1000 AS i, 1000 - m % 1000 AS j FROM (SELECT a, b, x, y, {_BLOCK} AS m FROM blocks WHERE x <> '' AND y <> ''))
  WHERE k > 0
), ratios AS (SELECT a, b, 2.0 * sum(k) / (length(a) + length(b)) AS ratio FROM blocks GROUP BY 1, 2)"""


def _alike_sql(vc: str, distinct: int, pairs: int) -> str:
    return vc.replace("WITH ", "WITH RECURSIVE ", 1) + _FORMS + f""", fit AS (SELECT col FROM groups GROUP BY 1 HAVING count(*) BETWEEN 2 AND {distinct} AND count(*) <= 0.3 * sum(total)),
  own AS (SELECT col, canonical, max(n) AS n FROM forms JOIN groups USING (col, form) WHERE value = canonical AND col IN (SELECT col FROM fit) AND length(canonical) >= 5 GROUP BY 1, 2),
  tried AS (SELECT p.col, p.canonical AS a, q.canonical AS b, p.n AS n_a, q.n AS n_b FROM own p JOIN own q ON p.col = q.col AND p.canonical < q.canonical){RATIO_SQL},
  alike AS (SELECT col, tried.a, tried.b, round(ratio, 3) AS similarity, CASE WHEN n_b > n_a THEN tried.b ELSE tried.a END AS canonical
    FROM tried JOIN ratios ON lower(tried.a) = ratios.a AND lower(tried.b) = ratios.b WHERE ratio >= 0.65 QUALIFY row_number() OVER (PARTITION BY col ORDER BY ratio DESC, tried.a, tried.b) <= {pairs})"""


def _counts_sql(table: str, columns: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value, count(*) AS n FROM {table} GROUP BY 2" for c in columns.split())
    return f"WITH solid AS (SELECT * FROM ({long}) WHERE NOT {_BLANK})"


_LINE = """WITH long AS (SELECT 'l_quantity' AS col, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)"""
_HIST = """WITH long AS (SELECT 'l_quantity' AS col, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS DOUBLE) FROM lineitem),
  ends AS (SELECT col, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM long GROUP BY 1)"""

SQL = {
    "vc_value_counts": VC_SQL + " SELECT col, value, n FROM vc",
    "a1_blank_rates": VC_SQL + f" SELECT col, sum(CASE WHEN {_BLANK} THEN n ELSE 0 END) / sum(n) AS blank_rate, bool_or({_BLANK}) AS nullable FROM vc GROUP BY 1",
    "a2_infer_schema": VC_SQL
    + f""", s AS (SELECT col, sum(CASE WHEN NOT {_BLANK} THEN n ELSE 0 END) AS f, sum(CASE WHEN NOT {_BLANK} AND {_V} IS NOT NULL THEN n ELSE 0 END) AS p, sum(n) AS r FROM vc GROUP BY 1)
    SELECT col, CASE WHEN f > 0 AND p >= 0.9 * f THEN 'numeric' ELSE 'categorical' END AS dtype, f < r AS nullable,
    CASE col WHEN 'lead_id' THEN 'id' WHEN 'disposition' THEN 'target' ELSE 'feature' END AS role FROM s""",
    "a3_overview": """SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM (DESCRIBE lineitem)) AS n_columns,
      (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows, CAST(0 AS BIGINT) AS empty_columns""",
    "a4_column_profiles": VC_SQL
    + f""", b AS (SELECT col, round(100.0 * sum(CASE WHEN {_BLANK} THEN n ELSE 0 END) / sum(n), 4) AS null_pct, count(*) FILTER (NOT {_BLANK}) AS n_distinct FROM vc GROUP BY 1),
    t AS (SELECT col, value AS top_value, n AS top_n FROM solid QUALIFY {_TOP} = 1) SELECT col, CAST(null_pct AS DOUBLE) AS null_pct, n_distinct, top_value, top_n FROM b LEFT JOIN t USING (col)""",
    "k1_top_values": VC_SQL + f" SELECT col, {_TOP} AS rank, value, n FROM solid QUALIFY {_TOP} <= 5",
    "a5_near_duplicates": VC_SQL + _FORMS + " SELECT col, canonical, n_variants, total, variants FROM groups WHERE n_variants > 1",
    "a7_merge_suggestions": VC_SQL + _FORMS + " SELECT col, value AS variant, canonical, TRUE AS confirmed FROM forms JOIN groups USING (col, form) WHERE value <> canonical",
    "a6_spelling_variants": _alike_sql(VC_SQL, 300, 15) + " SELECT * FROM alike",
    "j10_alike_names": _alike_sql(_counts_sql("part", "p_name p_type"), 2000, 60) + " SELECT * FROM alike",
    "a7_fuzzy_merges": _alike_sql(_counts_sql("part", "p_name p_type p_brand"), 300, 15)
    + """ SELECT col, value AS variant, canonical, TRUE AS confirmed FROM forms JOIN groups USING (col, form) WHERE value <> canonical
      UNION ALL SELECT col, CASE WHEN canonical = a THEN b ELSE a END, canonical, FALSE FROM alike""",
    "a8_literal_sentinels": _NUM
    + """, s AS (SELECT col, sentinel, sum(n) AS r, sum(CASE WHEN v = sentinel THEN n ELSE 0 END) AS c, min(v) FILTER (v <> sentinel) AS other_min, max(v) FILTER (v <> sentinel) AS other_max
      FROM num, (VALUES (CAST(0 AS DOUBLE)), (CAST(-1 AS DOUBLE))) AS q(sentinel) WHERE v IS NOT NULL GROUP BY 1, 2)
      SELECT col, sentinel, CAST(c AS BIGINT) AS count, c / r AS fraction, other_min, other_max FROM s WHERE r >= 30 AND c / r >= 0.01 AND c < r""",
    "a9_low_clusters": _NUM
    + """, v AS (SELECT col, v, sum(n) AS n FROM num WHERE v IS NOT NULL GROUP BY 1, 2),
      g AS (SELECT col, v AS low_max, lead(v) OVER (PARTITION BY col ORDER BY v) AS high_min FROM v),
      w AS (SELECT col, low_max, high_min, high_min - low_max AS gap FROM g WHERE high_min IS NOT NULL QUALIFY row_number() OVER (PARTITION BY col ORDER BY high_min - low_max DESC, low_max) = 1),
      s AS (SELECT col, gap, low_max, high_min, count(*) AS k, max(v) - min(v) AS span, sum(n) AS r, sum(CASE WHEN v <= low_max THEN n ELSE 0 END) AS c FROM v JOIN w USING (col) GROUP BY 1, 2, 3, 4)
      SELECT col, low_max, high_min, CAST(c AS BIGINT) AS count, c / r AS fraction FROM s WHERE k >= 3 AND r >= 30 AND gap >= 0.15 * span AND c / r BETWEEN 0.005 AND 0.95""",
    "a10_date_formats": VC_SQL + _DATES + " SELECT col, inference FROM dates",
    "a11_float_identifiers": VC_SQL
    + " SELECT col, sum(CASE WHEN regexp_matches(trim(value), '^[0-9]{5,}[.]0$') THEN n ELSE 0 END) / sum(n) AS fraction FROM solid GROUP BY 1 HAVING sum(CASE WHEN regexp_matches(trim(value), '^[0-9]{5,}[.]0$') THEN n ELSE 0 END) / sum(n) >= 0.5",
    "a12_multi_valued": VC_SQL + _MULTI + " SELECT share.col, share.delim AS delimiter, fraction, n_components, order_varies FROM chosen JOIN share USING (col, k) JOIN parts USING (col) JOIN varies USING (col)",
    "a13_free_text": VC_SQL
    + """, s AS (SELECT col, CAST(sum(n) AS BIGINT) AS rows, count(*) AS n_distinct, count(*) FILTER (n = 1) AS one FROM solid GROUP BY 1)
      SELECT col, rows, n_distinct, n_distinct / rows AS distinct_ratio, one / n_distinct AS singleton_ratio FROM s WHERE rows >= 20 AND n_distinct / rows >= 0.5 AND one / n_distinct >= 0.5""",
    "a14_numeric_distribution": _LINE
    + """, s AS (SELECT col, CAST(count(*) AS DOUBLE) AS count, min(v) AS min, max(v) AS max, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.05) AS p5,
      quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM long GROUP BY 1)
      SELECT col, metric, round(value, 4) AS value FROM s UNPIVOT (value FOR metric IN (count, min, max, mean, std, p1, p5, p25, p50, p75, p95, p99))""",
    "a14_text_distribution": _NUM
    + """, each AS (SELECT col, v FROM (SELECT col, v, unnest(range(CAST(n AS BIGINT))) FROM num WHERE v IS NOT NULL AND col IN ('score', 'balance', 'tenure'))), s AS (SELECT col, CAST(count(*) AS DOUBLE) AS count, min(v) AS min, max(v) AS max, avg(v) AS mean,
      coalesce(stddev_samp(v), 0) AS std, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM each GROUP BY 1)
      SELECT col, metric, round(value, 4) AS value FROM s UNPIVOT (value FOR metric IN (count, min, max, mean, std, p1, p5, p25, p50, p75, p95, p99))""",
    "a14_histogram": _HIST + " SELECT col, CAST(least(floor((v - lo) * 30 / (hi - lo)), 29) AS BIGINT) AS bin, count(*) AS n FROM long JOIN ends USING (col) GROUP BY 1, 2",
    "a15_categorical_distribution": VC_SQL
    + f""", t AS (SELECT col, {_TOP} AS rank, value, n FROM solid) SELECT col, rank, value, n FROM t WHERE rank <= 3
      UNION ALL SELECT col, 0, CAST(count(*) AS VARCHAR), CAST(sum(n) AS BIGINT) FROM t WHERE rank > 3 GROUP BY col""",
    "a16_date_distribution": VC_SQL
    + _DATES
    + " SELECT col, CAST(CAST(strptime(trim(value), '%d/%m/%Y') AS DATE) AS VARCHAR) AS day, CAST(sum(n) AS BIGINT) AS n FROM solid JOIN dates USING (col) WHERE inference = 'day_first' GROUP BY 1, 2",
    "a17_fingerprint": LEADS_SQL
    + ", h AS (SELECT md5(concat_ws(chr(31), "
    + ", ".join(f"coalesce({c}, chr(0))" for c in LEAD_COLUMNS)
    + ")) AS h FROM leads) SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS VARCHAR) AS hash FROM h",
    "a18_outcome": VC_SQL + " SELECT value, n, (SELECT count(*) FROM solid WHERE col = 'disposition') BETWEEN 2 AND 8 AS ordinal FROM solid WHERE col = 'disposition'",
}

_SECTIONS = {
    "schema": ("a2_infer_schema", "dtype nullable role"), "blanks": ("a1_blank_rates", "blank_rate nullable"), "columns": ("a4_column_profiles", "null_pct n_distinct top_value top_n"),
    "dates": ("a10_date_formats", "inference"), "near_duplicates": ("a5_near_duplicates", "canonical n_variants total"), "sentinels": ("a8_literal_sentinels", "sentinel count fraction other_min other_max"),
    "clusters": ("a9_low_clusters", "low_max high_min count fraction"), "float_ids": ("a11_float_identifiers", "fraction"),
    "multi_valued": ("a12_multi_valued", "delimiter fraction n_components order_varies"), "free_text": ("a13_free_text", "rows n_distinct distinct_ratio singleton_ratio"),
}
_CELL = lambda c: "'feature'" if c == "role" else f'CAST(q."{c}" AS VARCHAR)'
_ROWS = " UNION ALL ".join(f"SELECT '{section}' AS section, q.col, '{c}' AS metric, {_CELL(c)} AS value FROM ({SQL[name]}) AS q" for section, (name, columns) in _SECTIONS.items() for c in columns.split())
SQL["s13_full_profile"] = f"SELECT section, col, metric, coalesce(CAST(TRY_CAST(round(TRY_CAST(value AS DOUBLE), 6) AS DECIMAL(30, 6)) AS VARCHAR), value) AS value FROM ({_ROWS})"
