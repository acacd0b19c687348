"""Queries of derivation, mapping and batch validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelforge.functions import scalars as S
from funnelforge.operators import derive as D
from funnelforge.operators import mapping as M
from funnelforge.operators import profile as P
from funnelforge.plans.profile_queries import _BLANK, _FORMS, _MULTI, _V, RATIO_SQL, _vc
from funnelforge.plans.tables import LEADS_SQL, PAST_SQL, VC_SQL, leads, past_leads, table
from funnelforge.session import stored

FUNNEL = ["view", "click", "signup", "purchase"]
LEVELS = ["Asked", "Quoted", "Surveyed", "Signed"]


def _six(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def p1_is_blank(spark, sf_dir):
    return leads(spark, sf_dir).select("lead_id", S.is_blank(F.col("created_at")).alias("blank_created"), S.is_blank(F.col("tenure")).alias("blank_tenure"))


def f1_phone(spark, sf_dir):
    return leads(spark, sf_dir).select("lead_id", S.phone(F.col("phone")).alias("phone"))


def f2_number(spark, sf_dir):
    return leads(spark, sf_dir).select("lead_id", S.number(F.col("score")).alias("score"), S.number(F.col("balance")).alias("balance"), S.number(F.col("tenure")).alias("tenure"))


def f3_timestamp(spark, sf_dir):
    return leads(spark, sf_dir).select("lead_id", S.timestamp(F.col("created_at")).cast("string").alias("ts"))


def d1_temporal_features(spark, sf_dir):
    return D.temporal_features(_events(spark, sf_dir).select("event_id", "ts"), "ts").drop("ts")


def d2_funnel_stages(spark, sf_dir):
    return D.funnel_stages(_events(spark, sf_dir).select("event_id", "event_type"), "event_type", FUNNEL)


def d3_multi_valued(spark, sf_dir):
    return D.normalize_multi_valued(leads(spark, sf_dir).select("lead_id", "areas"), "areas", n=3)


def d4_duration_months(spark, sf_dir):
    return leads(spark, sf_dir).select("lead_id", S.duration_months(F.col("tenure")).alias("months"))


def d5_duration_bands(spark, sf_dir):
    return D.duration_features(leads(spark, sf_dir).select("lead_id", "tenure"), "tenure").select("lead_id", "tenure_band")


def k2_top_components(spark, sf_dir):
    return D.top_components(leads(spark, sf_dir), "areas", n=3)


def p2_apply_mapping(spark, sf_dir):
    rows = leads(spark, sf_dir).select("lead_id", "phone", "external_id", "tenure", "score", "areas")
    return M.apply_mapping(rows, {"id": ["lead_id"], "contact": ["phone", "external_id"], "age": ["tenure", "score"]})


def p3_stage_rows(spark, sf_dir):
    return D.stage_rows(_events(spark, sf_dir).select("event_id", "event_type"), "event_type", FUNNEL, 1)


def p4_role_projection(spark, sf_dir):
    rows = leads(spark, sf_dir)
    schema = P.infer_schema(P.value_counts(rows), {"lead_id": "id", "disposition": "target", "empty": "excluded"})
    return P.columns_of_role(rows, schema, "feature", "numeric", ("lead_id",))


def p7_apply_merges(spark, sf_dir):
    rows = leads(spark, sf_dir).select("lead_id", "source")
    return D.apply_merges(rows, "source", P.merge_suggestions(P.value_counts(rows, ["source"]), fuzzy=False))


def a19_validate_canonical(spark, sf_dir):
    return M.validate_canonical(leads(spark, sf_dir), ["lead_id", "created_at"], ["lead_id", "phone"], "phone", "created_at", "disposition")


def a19_canonical_issues(spark, sf_dir):
    """Leads without a field that training needs, phones that repeat or do not normalise, and
    creation dates that are read day-first."""
    rows = leads(spark, sf_dir).drop("notes").withColumn("phone", F.when(F.col("lead_id").cast("long") % 8 < 2, F.substring("phone", 1, 9)).otherwise(F.col("phone")))
    fields = [M.Field("lead_id", "always", True), M.Field("phone", "always", True), M.Field("notes", "train"), M.Field("owner", "train"), M.Field("gone", "no")]
    return M.canonical_issues(rows, fields, True)


def a24_outcome_by_age(spark, sf_dir):
    return _six(D.outcome_by_age(_events(spark, sf_dir), F.col("ts"), F.col("event_type") == "purchase", "2024-02-01"), "rate")


def a25_funnel_summary(spark, sf_dir):
    return _six(D.funnel_summary(_events(spark, sf_dir), "event_type", FUNNEL), "pass_through")


def a26_feature_profile(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("enriched", F.col("c_custkey") % 3 == 0)
    return _six(D.feature_profile(c, "enriched", ["c_acctbal", "c_nationkey"], ["c_mktsegment"]), "mean", "median")


def a27_signal_by_quartile(spark, sf_dir):
    return _six(D.signal_by_quartile(_events(spark, sf_dir), "value", F.col("event_type") == "purchase"), "rate")


def a28_signal_by_category(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return _six(D.signal_by_category(o, "o_orderpriority", F.col("o_orderstatus") == "F"), "rate")


def a31_funnel_report(spark, sf_dir):
    return D.funnel_report(_events(spark, sf_dir), "event_type", FUNNEL)


def a32_stage_summary(spark, sf_dir):
    return D.stage_summary(_events(spark, sf_dir), "event_type", FUNNEL)


def u2_level_check(spark, sf_dir):
    return D.level_check(leads(spark, sf_dir), "disposition", [*LEVELS, "Built"])


def _catalog(spark, sf_dir):
    """Two vocabularies of names out of the part table: some changed in case, lost or new."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))
    before = parts.where("p_partkey % 3 <> 0").select(F.col("name").alias("column"))
    name = F.when(F.col("p_partkey") % 4 == 0, F.upper(F.translate("name", " ", "_"))).otherwise(F.col("name"))
    return before.distinct(), parts.where("p_partkey % 5 <> 0").select(name.alias("column")).distinct()


def j4_column_diff(spark, sf_dir):
    return M.column_diff(*_catalog(spark, sf_dir))


#: Names that may stand for a colour or a sort in the part table.
ALIASES = {"azure": ["blue", "azure metal"], "copper": ["brass", "kupfer"], "small": ["small part", "mini"], "polished": ["burnished"], "steel": ["steel plate", "stahl"]}


def j5_suggest_mapping(spark, sf_dir):
    """Part names as the columns of a file per brand, ranked for each of some fields."""
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("column")).distinct()
    return M.suggest_mapping(names, ALIASES)


def j9_compare_findings(spark, sf_dir):
    raw = leads(spark, sf_dir)
    clean = D.apply_merges(raw, "source", P.merge_suggestions(P.value_counts(raw, ["source"]), fuzzy=False)).withColumn("external_id", F.regexp_replace("external_id", "[.]0$", ""))
    return M.compare_findings(M.findings(raw.select("source", "external_id", "areas", "notes")), M.findings(clean.select("source", "external_id", "areas", "notes")))


def _batch(spark, sf_dir):
    return P.value_counts(leads(spark, sf_dir).select("source", "score", "tenure", "areas"))


def _pinned(spark, sf_dir):
    return P.value_counts(past_leads(spark, sf_dir))


def j11_unseen_categories(spark, sf_dir):
    return M.unseen_categories(_batch(spark, sf_dir), M.vocabulary(_pinned(spark, sf_dir), ["source", "areas"]), ["source", "areas"])


def j12_schema_drift(spark, sf_dir):
    return M.schema_drift(P.infer_schema(_batch(spark, sf_dir)), P.infer_schema(_pinned(spark, sf_dir)).withColumn("nullable", F.lit(False)))


def a35_null_shift(spark, sf_dir):
    return _six(M.null_shift(P.blank_rates(_batch(spark, sf_dir)), P.blank_rates(_pinned(spark, sf_dir))), "batch_rate", "pinned_rate")


def a36_not_coercible(spark, sf_dir):
    return M.not_coercible(_vc(spark, sf_dir), ["score", "balance", "created_at"])


def a37_vocabulary(spark, sf_dir):
    return M.vocabulary(_vc(spark, sf_dir), ["source", "areas", "disposition"])


CHECKED = {"source": "categorical", "areas": "categorical", "score": "numeric", "tenure": "numeric", "phone": "categorical"}


def m13_preflight(spark, sf_dir):
    return M.preflight(_batch(spark, sf_dir), CHECKED, stored(M.pins(_pinned(spark, sf_dir), CHECKED), "pinned"))


def m13_verdict(spark, sf_dir):
    return M.verdict(m13_preflight(spark, sf_dir))


QUERIES = [
    p1_is_blank, f1_phone, f2_number, f3_timestamp, d1_temporal_features, d2_funnel_stages, d3_multi_valued, d4_duration_months, d5_duration_bands,
    k2_top_components, p2_apply_mapping, p3_stage_rows, p4_role_projection, p7_apply_merges, a19_validate_canonical, a19_canonical_issues, a24_outcome_by_age,
    a25_funnel_summary, a26_feature_profile, a27_signal_by_quartile, a28_signal_by_category, a31_funnel_report, a32_stage_summary, u2_level_check,
    j4_column_diff, j5_suggest_mapping, j9_compare_findings, j11_unseen_categories, j12_schema_drift, a35_null_shift, a36_not_coercible, a37_vocabulary, m13_preflight, m13_verdict,
]

_LEVEL = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END"
_UNIT = lambda k: f"lower(right(x[{k}], 1))"
_COUNT = lambda k: f"TRY_CAST(regexp_extract(x[{k}], '^[0-9]+') AS INTEGER)"
_AMOUNTS = r"regexp_extract_all(regexp_extract(trim(tenure), '^([0-9]+\s*[A-Za-z]+\s*)+'), '[0-9]+\s*[A-Za-z]')"
_MONTHS = f"(SELECT CASE WHEN {_UNIT(1)} = 'y' THEN {_COUNT(1)} * 12 + CASE WHEN {_UNIT(2)} = 'm' THEN {_COUNT(2)} ELSE 0 END WHEN {_UNIT(1)} = 'm' THEN {_COUNT(1)} END FROM (SELECT {_AMOUNTS} AS x))"
_BAND = "CASE WHEN m < 6 THEN '0-6' WHEN m < 12 THEN '6-12' WHEN m < 24 THEN '12-24' WHEN m < 60 THEN '24-60' WHEN m >= 60 THEN '60+' END"
_PARTS = r"list_filter(list_transform(string_split(areas, ';'), lambda x: trim(x)), lambda x: x <> '')"
_DIGITS = r"regexp_replace(regexp_replace(trim(phone), '[.]0$', ''), '[^0-9]', '', 'g')"
_B = lambda c: rf"({c} IS NULL OR regexp_full_match({c}, '\s*'))"
_N = lambda c: _V.replace("value", c)


def _counts(cols: str, rel: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value, count(*) AS n FROM {rel} GROUP BY 2" for c in cols.split())


_BATCH = LEADS_SQL + f", past AS ({PAST_SQL}), batch AS ({_counts('source score tenure areas', 'leads')}), pinned AS ({_counts('source score areas notes', 'past')})"
_RATE = lambda t: f"SELECT col, sum(CASE WHEN {_BLANK} THEN n ELSE 0 END) / sum(n) AS r FROM {t} GROUP BY 1"
_SOLID = f"NOT {_BLANK}"
_VOCAB = f"SELECT col, value FROM pinned WHERE col IN ('source', 'areas') AND {_SOLID}"
_SCHEMA = lambda t: f"SELECT col, CASE WHEN sum(CASE WHEN {_SOLID} THEN n ELSE 0 END) > 0 AND sum(CASE WHEN {_SOLID} AND {_V} IS NOT NULL THEN n ELSE 0 END) >= 0.9 * sum(CASE WHEN {_SOLID} THEN n ELSE 0 END) THEN 'numeric' ELSE 'categorical' END AS dtype, sum(CASE WHEN {_BLANK} THEN n ELSE 0 END) > 0 AS nullable FROM {t} GROUP BY 1"

_CHECKED = "source external_id areas notes"


def _FIND(cols: str, rel: str, select: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value, count(*) AS n FROM {rel} GROUP BY 2" for c in cols.split())
    return f"WITH solid AS (SELECT * FROM ({long}) WHERE {_SOLID}){_FORMS}{_MULTI} {select}"


def _ALL(rel: str) -> str:
    """Findings by kind; these columns hold no sentinels."""
    kinds = {
        "near_duplicate": "SELECT col FROM groups WHERE n_variants > 1",
        "date_format": "SELECT col FROM dates",
        "float_identifier": "SELECT col FROM solid GROUP BY 1 HAVING sum(CASE WHEN regexp_matches(trim(value), '^[0-9]{5,}[.]0$') THEN n ELSE 0 END) / sum(n) >= 0.5",
        "multi_valued": "SELECT col FROM chosen",
        "free_text": "SELECT col FROM solid GROUP BY 1 HAVING sum(n) >= 20 AND count(*) / sum(n) >= 0.5 AND count(*) FILTER (n = 1) / count(*) >= 0.5",
    }
    union = " UNION ALL ".join(f"SELECT '{k}' AS kind, col FROM ({q})" for k, q in kinds.items())
    return f"SELECT kind, count(*) AS n FROM ({_FIND(_CHECKED, rel, union)}) GROUP BY 1"


SQL = {
    "p1_is_blank": LEADS_SQL + f" SELECT lead_id, {_B('created_at')} AS blank_created, {_B('tenure')} AS blank_tenure FROM leads",
    "f1_phone": LEADS_SQL + f" SELECT lead_id, CASE WHEN length({_DIGITS}) >= 10 THEN right({_DIGITS}, 10) END AS phone FROM leads",
    "f2_number": LEADS_SQL + f" SELECT lead_id, {_N('score')} AS score, {_N('balance')} AS balance, {_N('tenure')} AS tenure FROM leads",
    "f3_timestamp": LEADS_SQL + " SELECT lead_id, CAST(try_strptime(trim(created_at), '%d/%m/%Y') AS VARCHAR) AS ts FROM leads",
    "d1_temporal_features": """SELECT event_id, CAST(month(ts) AS INTEGER) AS ts_month, CAST(isodow(ts) - 1 AS INTEGER) AS ts_day_of_week, CAST(hour(ts) AS INTEGER) AS ts_hour,
      CAST(isodow(ts) >= 6 AS INTEGER) AS ts_is_weekend, CAST(day(ts) AS INTEGER) AS ts_day_of_month, CAST((day(ts) - 1) // 7 + 1 AS INTEGER) AS ts_week_of_month FROM events""",
    "d2_funnel_stages": f"""SELECT event_id, event_type, CASE WHEN {_LEVEL} IS NOT NULL THEN event_type END AS event_type_stage, CAST({_LEVEL} >= 1 AS DOUBLE) AS reached_click,
      CAST({_LEVEL} >= 2 AS DOUBLE) AS reached_signup, CAST({_LEVEL} >= 3 AS DOUBLE) AS reached_purchase FROM events""",
    "d3_multi_valued": LEADS_SQL
    + f""", p AS (SELECT lead_id, areas, list_sort({_PARTS}) AS p FROM leads)
      SELECT lead_id, areas, array_to_string(p, '; ') AS areas_normalized, CAST(len(p) AS INTEGER) AS areas_count, list_contains(p, 'Roof') AS has_roof, list_contains(p, 'Cellar') AS has_cellar,
      list_contains(p, 'Porch') AS has_porch FROM p""",
    "d4_duration_months": LEADS_SQL + f" SELECT lead_id, CAST({_MONTHS} AS INTEGER) AS months FROM leads",
    "d5_duration_bands": LEADS_SQL + f", d AS (SELECT lead_id, {_MONTHS} AS m FROM leads) SELECT lead_id, {_BAND} AS tenure_band FROM d",
    "k2_top_components": LEADS_SQL + f" SELECT component, count(*) AS n FROM (SELECT unnest({_PARTS}) AS component FROM leads) GROUP BY 1 ORDER BY n DESC, component LIMIT 3",
    "p2_apply_mapping": LEADS_SQL + f" SELECT lead_id AS id, CASE WHEN NOT {_B('phone')} THEN phone ELSE external_id END AS contact, CASE WHEN NOT {_B('tenure')} THEN tenure ELSE score END AS age, areas AS extra__areas FROM leads",
    "p3_stage_rows": f"SELECT event_id, event_type, CAST({_LEVEL} > 1 AS INTEGER) AS y FROM events WHERE {_LEVEL} >= 1",
    "p4_role_projection": LEADS_SQL + " SELECT lead_id, balance, external_id, score FROM leads",
    "p7_apply_merges": VC_SQL + _FORMS + " SELECT lead_id, coalesce(canonical, source) AS source FROM leads LEFT JOIN (SELECT value, canonical FROM forms JOIN groups USING (col, form) WHERE col = 'source' AND value <> canonical) ON source = value",
    "a19_validate_canonical": LEADS_SQL
    + f""" SELECT 'missing' AS kind, 'lead_id' AS field, count(*) FILTER ({_B('lead_id')}) AS n, count(*) AS total FROM leads
      UNION ALL SELECT 'missing', 'created_at', count(*) FILTER ({_B('created_at')}), count(*) FROM leads
      UNION ALL SELECT 'phone_normalized', 'phone', count(*) FILTER (length({_DIGITS}) >= 10), count(*) FILTER (NOT {_B('phone')}) FROM leads
      UNION ALL SELECT 'date_parsed', 'created_at', count(try_strptime(trim(created_at), '%d/%m/%Y')), count(*) FILTER (NOT {_B('created_at')}) FROM leads
      UNION ALL SELECT 'duplicate', 'lead_id', 0, count(*) FROM leads
      UNION ALL SELECT 'duplicate', 'phone', count(*) FILTER (k > 1), CAST(sum(k) AS BIGINT) FROM (SELECT phone, count(*) AS k FROM leads WHERE NOT {_B('phone')} GROUP BY 1)
      UNION ALL SELECT 'disposition', disposition, count(*), NULL FROM leads WHERE NOT {_B('disposition')} GROUP BY 2""",
    "a19_canonical_issues": LEADS_SQL
    + f""", r AS (SELECT CASE WHEN CAST(lead_id AS BIGINT) % 8 < 2 THEN substr(phone, 1, 9) ELSE phone END AS phone, created_at FROM leads),
      p AS (SELECT phone, length({_DIGITS}) >= 10 AS fits FROM r WHERE NOT {_B('phone')}), x AS (SELECT count(*) FILTER (NOT fits) AS n, count(*) AS total FROM p)
      SELECT 'missing_required_field' AS kind, unnest(['notes', 'owner']) AS field, 'error' AS severity, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total, '' AS examples
      UNION ALL SELECT 'duplicate_value', 'phone', 'error', count(*), CAST(sum(k) AS BIGINT), '' FROM (SELECT phone, count(*) AS k FROM p GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
      UNION ALL SELECT 'low_phone_match_rate', 'phone', 'error', n, total, (SELECT array_to_string(list_sort(list(DISTINCT phone))[1:10], '|') FROM p WHERE NOT fits) FROM x WHERE total - n < 0.9 * total
      UNION ALL SELECT 'unparsed_created_at', 'created_at', 'warning', n, total, '' FROM (SELECT count(*) FILTER (try_strptime(trim(created_at), '%d/%m/%Y') IS NULL) AS n, count(*) AS total FROM r WHERE NOT {_B('created_at')}) WHERE n > 0""",
    "a24_outcome_by_age": """WITH d AS (SELECT floor(epoch(TIMESTAMP '2024-02-01' - ts) / 86400) AS d, CAST(event_type = 'purchase' AS INTEGER) AS y FROM events)
      SELECT CASE WHEN d < 7 THEN '[0,7)' WHEN d < 14 THEN '[7,14)' WHEN d < 30 THEN '[14,30)' WHEN d < 60 THEN '[30,60)' WHEN d < 90 THEN '[60,90)' ELSE '[90,inf)' END AS bin, count(*) AS n, round(avg(y), 6) AS rate FROM d WHERE d >= 0 GROUP BY 1""",
    "a25_funnel_summary": f"""WITH l AS (SELECT {_LEVEL} AS k FROM events), s AS (SELECT level, stage, (SELECT count(*) FROM l WHERE k >= level) AS reached FROM (VALUES (0, 'view'), (1, 'click'), (2, 'signup'), (3, 'purchase')) AS q(level, stage)),
      p AS (SELECT *, reached / lag(reached) OVER (ORDER BY level) AS r FROM s) SELECT level, stage, reached, round(r, 6) AS pass_through, coalesce(reached < 50 OR r > 0.95, FALSE) AS degenerate FROM p""",
    "a26_feature_profile": """WITH c AS (SELECT *, c_custkey % 3 = 0 AS enriched FROM customer)
      SELECT enriched, 'c_acctbal' AS feature, count(*) AS count, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median, CAST(NULL AS BIGINT) AS n_distinct FROM c GROUP BY 1
      UNION ALL SELECT enriched, 'c_nationkey', count(*), round(avg(c_nationkey), 6), round(median(c_nationkey), 6), NULL FROM c GROUP BY 1
      UNION ALL SELECT enriched, 'c_mktsegment', count(*), NULL, NULL, count(DISTINCT c_mktsegment) FROM c GROUP BY 1""",
    "a27_signal_by_quartile": """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c, min(value) AS lo FROM events)
      SELECT CAST(greatest(CAST(value > lo AS INTEGER) + CAST(value > a AS INTEGER) + CAST(value > b AS INTEGER) + CAST(value > c AS INTEGER), 1) AS BIGINT) AS bucket, count(*) AS n,
      round(avg(CAST(event_type = 'purchase' AS INTEGER)), 6) AS rate FROM events, q WHERE value IS NOT NULL GROUP BY 1""",
    "a28_signal_by_category": "SELECT o_orderpriority AS category, count(*) AS n, round(avg(CAST(o_orderstatus = 'F' AS INTEGER)), 6) AS rate FROM orders GROUP BY 1 ORDER BY avg(CAST(o_orderstatus = 'F' AS INTEGER)) DESC, 1 LIMIT 20",
    "a31_funnel_report": f"SELECT CASE WHEN {_LEVEL} IS NOT NULL THEN 'stage' ELSE 'unmapped' END AS kind, event_type AS value, count(*) AS n FROM events GROUP BY 1, 2",
    "a32_stage_summary": f"WITH l AS (SELECT {_LEVEL} AS k FROM events) SELECT CAST(s AS INTEGER) AS stage, count(*) AS n_rows, count(*) FILTER (k > s) AS n_positive, count(*) FILTER (k > s) < 50 AS sparse FROM l, range(0, 3) AS q(s) WHERE k >= s GROUP BY 1, s",
    "u2_level_check": LEADS_SQL
    + """, d AS (SELECT DISTINCT trim(disposition) AS value FROM leads WHERE disposition IS NOT NULL), k(value) AS (VALUES ('Asked'), ('Quoted'), ('Surveyed'), ('Signed'), ('Built'))
      SELECT value, 'not configured' AS kind FROM (SELECT value FROM d EXCEPT SELECT value FROM k) UNION ALL SELECT value, 'not in data' FROM (SELECT value FROM k EXCEPT SELECT value FROM d)""",
    "j11_unseen_categories": _BATCH
    + f""" SELECT col, value, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rank FROM batch ANTI JOIN ({_VOCAB}) USING (col, value)
      WHERE col IN ('source', 'areas') AND {_SOLID} QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, value) <= 10""",
    "j12_schema_drift": _BATCH
    + f""", a AS ({_SCHEMA('batch')}), p AS ({_SCHEMA('pinned')}) SELECT col, 'missing_column' AS kind FROM p WHERE col NOT IN (SELECT col FROM a) UNION ALL SELECT col, 'unexpected_column' FROM a WHERE col NOT IN (SELECT col FROM p)
      UNION ALL SELECT col, 'dtype_mismatch' FROM a JOIN p USING (col) WHERE a.dtype <> p.dtype UNION ALL SELECT col, 'null_violation' FROM a JOIN p USING (col) WHERE a.nullable""",
    "a35_null_shift": _BATCH
    + f""", a AS ({_RATE('batch')}), p AS ({_RATE('pinned')})
      SELECT col, round(a.r, 6) AS batch_rate, round(CAST(p.r AS DOUBLE), 6) AS pinned_rate FROM a JOIN p USING (col) WHERE abs(a.r - p.r) > 0.2""",
    "a36_not_coercible": VC_SQL
    + f""", bad AS (SELECT col, value, n FROM solid WHERE col IN ('score', 'balance', 'created_at') AND {_V} IS NULL)
      SELECT col, CAST(sum(n) AS BIGINT) AS n, array_to_string(list_sort(list(DISTINCT value))[1:10], '|') AS examples FROM bad GROUP BY 1""",
    "a37_vocabulary": VC_SQL + " SELECT col, value FROM solid WHERE col IN ('source', 'areas', 'disposition')",
    "m13_preflight": _BATCH
    + f""" SELECT 'phone' AS col, 'missing_feature' AS kind, 'error' AS severity, CAST(0 AS BIGINT) AS n
      UNION ALL SELECT col, 'not_coercible', 'error', CAST(sum(n) AS BIGINT) FROM batch WHERE col IN ('score', 'tenure') AND {_SOLID} AND {_V} IS NULL GROUP BY col
      UNION ALL SELECT col, 'unseen_category', 'warning', CAST(sum(n) AS BIGINT) FROM batch ANTI JOIN ({_VOCAB}) USING (col, value) WHERE col IN ('source', 'areas') AND {_SOLID} GROUP BY col
      UNION ALL SELECT col, 'null_shift', 'warning', 0 FROM ({_RATE('batch')}) a JOIN ({_RATE('pinned')}) p USING (col) WHERE abs(a.r - p.r) > 0.2""",
    "j4_column_diff": r"""WITH parts AS (SELECT p_partkey, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS name FROM part), b AS (SELECT DISTINCT name FROM parts WHERE p_partkey % 3 <> 0),
      a AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN upper(replace(name, ' ', '_')) ELSE name END AS name FROM parts WHERE p_partkey % 5 <> 0),
      gone AS (SELECT name, plain, row_number() OVER (PARTITION BY plain ORDER BY name) AS k FROM (SELECT name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS plain FROM b WHERE name NOT IN (SELECT name FROM a))),
      new AS (SELECT name, plain, row_number() OVER (PARTITION BY plain ORDER BY name) AS k FROM (SELECT name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS plain FROM a WHERE name NOT IN (SELECT name FROM b)))
      SELECT name AS "column", name AS other, 'unchanged' AS kind FROM a JOIN b USING (name) UNION ALL
      SELECT gone.name, new.name, CASE WHEN new.name IS NULL THEN 'removed' WHEN gone.name IS NULL THEN 'added' ELSE 'renamed' END FROM gone FULL JOIN new USING (plain, k)""",
    "j5_suggest_mapping": rf"""WITH RECURSIVE names AS (SELECT DISTINCT p_brand AS file, p_name AS "column", regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS plain FROM part),
      known(field, alias) AS (VALUES {", ".join(f"('{f}', '{a.replace(' ', '')}')" for f, more in ALIASES.items() for a in (f, *more))}),
      tried AS (SELECT DISTINCT plain AS a, alias AS b, field FROM names, known WHERE plain <> ''){RATIO_SQL},
      best AS (SELECT a, field, max(CASE WHEN a = b THEN 0.95 ELSE ratio END) AS c FROM tried JOIN ratios USING (a, b) GROUP BY 1, 2 HAVING c >= 0.55)
      SELECT file, field, row_number() OVER (PARTITION BY file, field ORDER BY c DESC, "column") AS rank, "column", round(CAST(c AS DOUBLE), 3) AS confidence FROM names JOIN best ON plain = a""",
    "j9_compare_findings": LEADS_SQL
    + f""", raw AS (SELECT source, external_id, areas, notes FROM leads), spell AS (SELECT value, canonical FROM ({_FIND("source", "raw", "SELECT value, canonical FROM forms JOIN groups USING (col, form)")})),
      clean AS (SELECT coalesce(canonical, source) AS source, regexp_replace(external_id, '[.]0$', '') AS external_id, areas, notes FROM raw LEFT JOIN spell ON source = value),
      a AS ({_ALL("raw")}), b AS ({_ALL("clean")})
      SELECT kind, CAST(coalesce(a.n, 0) AS BIGINT) AS before_n, CAST(coalesce(b.n, 0) AS BIGINT) AS after_n FROM a FULL JOIN b USING (kind)""",
}
SQL["m13_verdict"] = f"SELECT count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings, count(*) FILTER (severity = 'error') = 0 AS scoreable FROM ({SQL['m13_preflight']})"
