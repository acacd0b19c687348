"""Queries of bureau features and of assembly: orders are accounts, customers are leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from funnelforge.functions import bureau as C
from funnelforge.operators import assemble as A
from funnelforge.operators import bureau as B
from funnelforge.plans.tables import table
from funnelforge.session import scratch_path
from funnelforge.sources import enrich

#: Both engines read this: an account per order.
_ACCOUNTS = """
  SELECT o_orderkey, o_custkey,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Personal Loan' WHEN '2-HIGH' THEN 'Credit Card' WHEN '3-MEDIUM' THEN 'Gold-Loan' WHEN '4-NOT SPECIFIED' THEN 'HOUSING LOAN' ELSE 'Kisan Credit Card' END AS type,
    CASE o_orderkey % 7 WHEN 0 THEN 'HDFC Bank Ltd' WHEN 1 THEN 'State Bank of India' WHEN 2 THEN 'Bajaj Finance' WHEN 3 THEN 'Muthoot Fincorp' WHEN 4 THEN 'Arcil' WHEN 5 THEN 'Citibank N.A.' ELSE 'Some Cooperative' END AS institution,
    CASE o_orderstatus WHEN 'F' THEN 'Closed  Account' WHEN 'P' THEN 'Settled' ELSE 'Current Account' END AS status,
    CAST(floor(o_totalprice) AS {int}) AS sanction, CAST(floor(o_totalprice / 2) AS {int}) AS balance, CAST(floor(o_totalprice / 36) AS {int}) AS installment, o_orderkey % 1000 * 100 AS credit_limit,
    CAST(o_orderdate AS DATE) AS reported, {opened} AS opened, CASE WHEN o_orderkey % 50 = 0 THEN 'Suit Filed' WHEN o_orderkey % 70 = 0 THEN 'Wilful' ELSE '*' END AS suit
  FROM orders
"""
_OPENED = {"spark": "date_sub(CAST(o_orderdate AS DATE), CAST(o_orderkey % 2000 AS INT))", "duckdb": "CAST(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 2000 AS INTEGER) AS DATE)"}
ACCOUNTS_SQL = "WITH accs AS (" + _ACCOUNTS.format(int="BIGINT", opened=_OPENED["duckdb"]) + "), mine AS (SELECT * FROM accs WHERE o_custkey % 5 <> 0)"


def _accounts(spark, sf_dir):
    return spark.sql(_ACCOUNTS.format(int="BIGINT", opened=_OPENED["spark"]).replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def _responses(spark, sf_dir):
    """A response log: one response per customer with orders, most of them matched."""
    text = lambda c: F.col(c).cast("string")
    a = F.struct(
        F.col("type").alias("accountType"), "institution", text("credit_limit").alias("creditLimit"),
        F.format_number("sanction", 0).alias("sanctionAmount"), text("installment").alias("installmentAmount"), text("balance").alias("balance"),
        F.col("status").alias("accountStatus"), F.date_format("reported", "dd/MM/yyyy").alias("dateReported"), F.date_format("opened", "yyyy-MM-dd").alias("dateOpened"),
        F.array(F.struct(F.col("suit").alias("suitFiledStatus"))).alias("history48Months"),
    )
    # A customer's orders are few, and they are the response.
    per = _accounts(spark, sf_dir).groupBy("o_custkey").agg(F.collect_list(a).alias("accs"))
    k = F.col("o_custkey")
    reason = F.when(k % 3 == 0, "Vintage in Bureau").when(k % 3 == 1, " overdue amount ").otherwise("Something new")
    report = F.struct(
        F.col("accs").alias("retailAccountDetails"),
        F.struct(F.lit("120").alias("mostSevereStatusWithIn24Months"), (k % 4).cast("string").alias("noOfPastDueAccounts")).alias("retailAccountsSummary"),
        F.array(F.struct(F.when(k % 10 == 1, "-1").otherwise((300 + k % 600).cast("string")).alias("value"), F.array(F.struct(reason.alias("description"))).alias("scoringElements"))).alias("scoreDetails"),
        F.struct(
            F.struct(F.when(k % 2 == 0, "F").otherwise("M").alias("gender"), F.lit("15/06/1980").alias("dateOfBirth")).alias("personalInfo"),
            F.struct(F.when(k % 2 == 0, "ABCDE").alias("pANId"), F.lit("").alias("nationalIDCard"), F.lit("x").alias("otherId")).alias("identityInfo"),
        ).alias("iDAndContactInfo"),
    )
    payload = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(report.alias("cIRReportData"))).alias("cIRReportDataLst")).alias("cCRResponse")).alias("data")))
    return per.select(
        F.lit("r1").alias("run_id"), k.alias("lead_id"), F.when(k % 5 == 0, "SUCCESS_NO_HIT").otherwise("SUCCESS_MATCHED").alias("status"), payload.alias("payload_json"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=k % 500)).alias("fetched_at"), F.concat(F.lit("b"), (k % 3).cast("string")).alias("batch_id"),
    )


def _accs(spark, sf_dir):
    return B.accounts(B.parsed(_responses(spark, sf_dir)))


def s11_response_log(spark, sf_dir):
    """The last of two runs in a log that is partitioned by source and run."""
    root = scratch_path(spark, "response-log")
    rows = _responses(spark, sf_dir).withColumns({"source": F.lit("bureau"), "attempts": F.lit(1), "lead_id": F.col("lead_id").cast("string")})
    earlier = rows.withColumns({"run_id": F.lit("r0"), "status": F.lit("SUCCESS_NO_HIT"), "payload_json": F.lit(None).cast("string")})
    for run in (earlier, rows):
        enrich.append_responses(run, root)
    runs = spark.sql("SELECT * FROM VALUES ('bureau', 'r0', 1, 'finished'), ('bureau', 'r1', 2, 'finished'), ('bureau', 'r2', 3, 'open') AS t(source, run_id, started_at, state)")
    reports = B.parsed(enrich.latest_responses(enrich.response_log(spark, root), runs))
    return reports.select(F.col("lead_id").cast("long").alias("lead_id"), "status", F.when(F.col("report").isNotNull(), F.size("report.retailAccountDetails")).cast("long").alias("n_accounts"))


def b2_account_type(spark, sf_dir):
    return _accounts(spark, sf_dir).select("o_orderkey", C.account_type(F.col("type")).alias("bucket"))


def b3_is_active(spark, sf_dir):
    return _accounts(spark, sf_dir).select("o_orderkey", C.is_active(F.col("status")).alias("active"))


def b4_institution(spark, sf_dir):
    return _accounts(spark, sf_dir).select("o_orderkey", C.institution(F.col("institution")).alias("category"))


def b5_segment(spark, sf_dir):
    return _accounts(spark, sf_dir).select("o_orderkey", C.segment(C.institution(F.col("institution")), F.col("institution")).alias("segment"))


def _part(names):
    return lambda spark, sf_dir: B.portfolio(_accs(spark, sf_dir)).select("lead_id", *names)


COUNTS = ["total_accounts", "active_accounts", "active_pct", "closed_accounts", "closed_pct", "settled_accounts", "writtenoff_or_settled_pct"]
AMOUNTS = ["total_credit_limit", "total_active_credit_limit", "total_sanction_amount", "total_active_sanction_amount", "total_balance_amount", "total_monthly_payment_amount"]
BY_KIND = [f"{p}_{b}" for b in C.BUCKETS for p in ("num", "active_count")] + [f"{p}_count_institution_segment_{s}" for s in C.SEGMENTS.values() for p in ("total", "active")] + ["total_count_institution_category_psu_bank"]
SHARES = (
    [f"pct_of_total_sanctioned_amount_{B.short(b)}" for b in B.SANCTION_SHARES] + [f"pct_of_total_sanctioned_amount_active_{B.short(b)}" for b in B.SANCTION_SHARES]
    + [f"pct_of_total_balance_amount_active_{B.short(b)}" for b in B.BALANCE_SHARES] + [f"pct_of_total_installment_amount_active_{B.short(b)}" for b in B.INSTALLMENT_SHARES]
)


def b6_portfolio(spark, sf_dir):
    return _part(COUNTS)(spark, sf_dir)


def b7_ages(spark, sf_dir):
    return B.ages(_accs(spark, sf_dir)).drop("run_id", "last")


def b8_amounts(spark, sf_dir):
    return _part(AMOUNTS)(spark, sf_dir)


def b9_bucket_counts(spark, sf_dir):
    return _part(BY_KIND)(spark, sf_dir)


def b10_is_premium(spark, sf_dir):
    return _part(["is_premium"])(spark, sf_dir)


def b11_diversity(spark, sf_dir):
    return _part(["credit_diversity_index"])(spark, sf_dir)


def b12_shares(spark, sf_dir):
    return _part(SHARES)(spark, sf_dir)


def b13_suits(spark, sf_dir):
    return B.suits(_accs(spark, sf_dir)).drop("run_id")


def b14_person(spark, sf_dir):
    reports = B.parsed(_responses(spark, sf_dir))
    return B.person(reports, B.ages(B.accounts(reports)).select("run_id", "lead_id", "last")).drop("run_id")


def b14_unmapped_reasons(spark, sf_dir):
    return B.unmapped_reasons(B.parsed(_responses(spark, sf_dir)))


def b1_all_features(spark, sf_dir):
    """Every feature of every response; unmatched ones are null throughout."""
    return B.features(_responses(spark, sf_dir)).drop("run_id")


def _flat(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    payload = F.to_json(F.struct((k % 30 * 20).alias("score"), (k % 9).alias("total_accounts"), (k % 4).alias("active_accounts"), (k % 2).alias("overdue_accounts"), "c_acctbal", F.col("c_acctbal").alias("total_outstanding"), F.concat((k % 8).cast("string"), F.lit("yrs "), (k % 12).cast("string"), F.lit("mon")).alias("credit_history_length_text")))
    return c.select(F.lit("f1").alias("run_id"), k.alias("lead_id"), F.when(k % 5 < 2, "SUCCESS_MATCHED").when(k % 5 == 2, "ERROR").when(k % 5 == 3, "NOT_SENT").otherwise("SUCCESS_NO_HIT").alias("status"), payload.alias("payload_json"), F.lit("2024-01-02").cast("timestamp").alias("fetched_at"), F.lit("b0").alias("batch_id"), "c_mktsegment")


def b15_flat_features(spark, sf_dir):
    return B.flat_features(_flat(spark, sf_dir)).drop("run_id")


FLAT = ["crif_score", "crif_total_accounts"]


def _assembled(spark, sf_dir):
    spine = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lead_id"), "c_mktsegment")
    flat, nested = _flat(spark, sf_dir), _responses(spark, sf_dir)
    crif = B.flat_features(flat).select("lead_id", *FLAT).join(flat.select("lead_id", "status", "fetched_at", "batch_id"), "lead_id")
    return A.assemble(spine, {"crif": A.source_frame(crif, "crif", FLAT), "equifax": A.source_frame(nested, "equifax", [])})


def j1_assemble(spark, sf_dir):
    found = _assembled(spark, sf_dir)
    return found.select("lead_id", "c_mktsegment", *FLAT, "crif_match_status", "crif_is_enriched", "equifax_match_status", "equifax_batch_id", "equifax_is_enriched")


def d6_source_frame(spark, sf_dir):
    flat = _flat(spark, sf_dir)
    met = B.flat_features(flat).join(flat.select("lead_id", "status", "fetched_at", "batch_id"), "lead_id")
    return A.source_frame(met, "crif", FLAT).select("lead_id", "crif_match_status", "crif_batch_id", "crif_is_enriched")


def p5_enriched_mask(spark, sf_dir):
    return B.flat_features(_flat(spark, sf_dir)).select("lead_id", A.any_known(["crif_score", "crif_credit_history_months"]).alias("enriched"))


def _log(spark, sf_dir):
    """A log of several runs: events are responses, users are leads, days are runs."""
    e = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    status = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "SUCCESS_MATCHED").when(F.col("event_type") == "click", "SUCCESS_NO_HIT").otherwise("NOT_SENT")
    return e.select(F.concat(F.lit("run"), day.cast("string")).alias("run_id"), F.concat(F.lit("s"), (day % 7).cast("string")).alias("source"), F.col("user_id").alias("lead_id"), status.alias("status"), F.col("ts").alias("fetched_at"))


def _runs(spark, sf_dir):
    log = _log(spark, sf_dir)
    return log.groupBy("source", "run_id").agg(F.min("fetched_at").alias("started_at"), F.count(F.lit(1)).alias("rows_attempted"), (F.count(F.when(F.col("status") == "SUCCESS_MATCHED", 1)) + F.when(F.col("run_id") == "run3", 1).otherwise(0)).alias("matched"))


def w9_latest_runs(spark, sf_dir):
    return A.latest_runs(_runs(spark, sf_dir))


def j2_repeated_responses(spark, sf_dir):
    return A.repeated_responses(_log(spark, sf_dir))


def a20_run_summary(spark, sf_dir):
    return A.run_summary(_log(spark, sf_dir))


def a21_coverage(spark, sf_dir):
    return A.coverage(A.run_summary(_log(spark, sf_dir)))


def a22_coverage_by_level(spark, sf_dir):
    return A.coverage_by_level(_assembled(spark, sf_dir), ["crif", "equifax"], "c_mktsegment").withColumn("rate", F.round("rate", 6))


def a23_batch_invariants(spark, sf_dir):
    return A.batch_invariants(_runs(spark, sf_dir), _log(spark, sf_dir))


def j3_timing_leaks(spark, sf_dir):
    log = _log(spark, sf_dir)
    first = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.col("user_id").alias("lead_id")).agg(F.min("ts").alias("outcome_at"))
    found = A.timing_leaks(log, first)
    return found.select("lead_id", F.col("fetched_at").cast("string").alias("fetched_at"), F.col("outcome_at").cast("string").alias("outcome_at"))


def a33_formula_consistency(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_quantity").alias("q"), F.when(F.col("l_linenumber") == 3, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("p"))
    return A.formula_consistency(rows, A.sum_invariant("q", ["p"])).withColumn("pass_rate", F.round("pass_rate", 6))


def v3_le_invariant(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("source"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return A.formula_consistency(rows, A.le_invariant("a", "b")).withColumn("pass_rate", F.round("pass_rate", 6))


QUERIES = [
    s11_response_log, b1_all_features, b2_account_type, b3_is_active, b4_institution, b5_segment, b6_portfolio, b7_ages, b8_amounts, b9_bucket_counts,
    b10_is_premium, b11_diversity, b12_shares, b13_suits, b14_person, b14_unmapped_reasons, b15_flat_features, j1_assemble, d6_source_frame,
    p5_enriched_mask, w9_latest_runs, j2_repeated_responses, a20_run_summary, a21_coverage, a22_coverage_by_level, a23_batch_invariants,
    j3_timing_leaks, a33_formula_consistency, v3_le_invariant,
]

_BUCKET = "CASE type WHEN 'Personal Loan' THEN 'personal_loans' WHEN 'Credit Card' THEN 'credit_cards' WHEN 'Gold-Loan' THEN 'gold_loans' WHEN 'HOUSING LOAN' THEN 'home_loans' ELSE 'business_loans' END"
_CATEGORY = "CASE institution WHEN 'HDFC Bank Ltd' THEN 'Private Bank' WHEN 'State Bank of India' THEN 'PSU Bank' WHEN 'Citibank N.A.' THEN 'Foreign Bank' WHEN 'Arcil' THEN 'Asset Reconstruction Company' WHEN 'Some Cooperative' THEN 'Other / Unclassified' ELSE 'NBFC' END"
_SEGMENT = "CASE institution WHEN 'HDFC Bank Ltd' THEN 'Mainstream' WHEN 'State Bank of India' THEN 'Mainstream' WHEN 'Citibank N.A.' THEN 'Premium' WHEN 'Arcil' THEN 'Distressed' WHEN 'Bajaj Finance' THEN 'Mass Market - Digital' WHEN 'Muthoot Fincorp' THEN 'Mass Market - Secured' ELSE 'Unclassified' END"
_P = ACCOUNTS_SQL + f", p AS (SELECT o_custkey AS lead_id, *, {_BUCKET} AS bucket, {_CATEGORY} AS category, {_SEGMENT} AS segment, status = 'Current Account' AS active FROM mine)"
_pct = lambda a, b: f"round(CAST(100.0 * ({a}) / nullif({b}, 0) AS DOUBLE), 4)"
_sum = lambda c, cond="TRUE": f"CAST(coalesce(sum({c}) FILTER ({cond}), 0) AS DOUBLE)"
_share = lambda c, b, cond="TRUE": _pct(_sum(c, f"bucket = '{b}' AND {cond}"), _sum(c, cond))


def _per(columns: dict[str, str]) -> str:
    return _P + " SELECT lead_id, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM p GROUP BY lead_id"


_FLATS = """WITH flat AS (SELECT c_custkey AS lead_id, c_mktsegment, CASE WHEN c_custkey % 5 < 2 THEN 'SUCCESS_MATCHED' WHEN c_custkey % 5 = 2 THEN 'ERROR' WHEN c_custkey % 5 = 3 THEN 'NOT_SENT' ELSE 'SUCCESS_NO_HIT' END AS status,
  c_custkey % 5 < 2 AS m, c_custkey % 30 * 20 AS s, c_acctbal FROM customer),
  f AS (SELECT lead_id, c_mktsegment, status, CASE WHEN m AND s NOT IN (0, 10, 11, 12, 13, 14, 15, 16, 17, 18) THEN CAST(s AS DOUBLE) END AS crif_score, CASE WHEN m THEN CAST(lead_id % 9 AS DOUBLE) END AS crif_total_accounts,
    CASE WHEN m THEN CAST(lead_id % 4 AS DOUBLE) END AS crif_active_accounts, CASE WHEN m THEN CAST(lead_id % 2 AS DOUBLE) END AS crif_overdue_accounts, CASE WHEN m THEN c_acctbal END AS crif_total_outstanding,
    CASE WHEN m THEN CAST(lead_id % 8 * 12 + lead_id % 12 AS INTEGER) END AS crif_credit_history_months FROM flat)"""
_JOINED = _FLATS + """, e AS (SELECT DISTINCT o_custkey AS lead_id, CASE WHEN o_custkey % 5 = 0 THEN 'SUCCESS_NO_HIT' ELSE 'SUCCESS_MATCHED' END AS equifax_match_status, 'b' || CAST(o_custkey % 3 AS VARCHAR) AS equifax_batch_id FROM orders),
  j AS (SELECT lead_id, c_mktsegment, crif_score, crif_total_accounts, status AS crif_match_status, crif_total_accounts IS NOT NULL AS crif_is_enriched, equifax_match_status, equifax_batch_id,
    coalesce(equifax_match_status = 'SUCCESS_MATCHED', FALSE) AS equifax_is_enriched FROM f LEFT JOIN e USING (lead_id))"""
_LOG = """WITH log AS (SELECT 'run' || CAST(day(ts) AS VARCHAR) AS run_id, 's' || CAST(day(ts) % 7 AS VARCHAR) AS source, user_id AS lead_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'SUCCESS_MATCHED' WHEN 'click' THEN 'SUCCESS_NO_HIT' ELSE 'NOT_SENT' END AS status, ts AS fetched_at FROM events)"""
_SUMMARY = "SELECT run_id, count(*) AS rows_attempted, count(*) FILTER (status = 'SUCCESS_MATCHED') AS matched, count(*) FILTER (status = 'SUCCESS_NO_HIT') AS no_hit, count(*) FILTER (status = 'ERROR') AS error, count(*) FILTER (status = 'NOT_SENT') AS not_sent FROM log GROUP BY 1"
_FORMULA = lambda src, h: f"""WITH r AS (SELECT {src} AS source, CAST({h} AS INTEGER) AS h FROM lineitem), g AS (SELECT source, avg(h) AS pass_rate, CAST(grouping(source) AS INTEGER) AS is_total FROM r GROUP BY ROLLUP (source)),
  s AS (SELECT max(pass_rate) - min(pass_rate) AS spread FROM g WHERE is_total = 0) SELECT source, is_total, round(pass_rate, 6) AS pass_rate, pass_rate < 0.95 OR spread > 0.15 AS fails FROM g, s"""  # noqa: E731
_AGE = "greatest(0, (year(last) - year(opened)) * 12 + month(last) - month(opened))"

PERSON = [
    "score", "summary_most_severe_status_with_in24_months", "summary_no_of_past_due_accounts", *(f"reason_count_{k}" for k in B.REASONS), "gender", "age_years",
    "has_pan", "has_passport", "has_voter_id",
]
AGES = ["oldest_account_age_months", "newest_account_age_months", "average_account_age_months"]


def _everything(sql: dict[str, str]) -> str:
    """All features of all responses, out of the SQL of the parts."""
    parts = {"b6_portfolio": COUNTS, "b7_ages": AGES, "b8_amounts": AMOUNTS, "b9_bucket_counts": BY_KIND, "b10_is_premium": ["is_premium"], "b11_diversity": ["credit_diversity_index"], "b12_shares": SHARES, "b13_suits": ["suit_filed_status_values"], "b14_person": PERSON}
    names = ", ".join(f"{k}.{c} AS equifax_{c}" for k, cols in parts.items() for c in cols)
    joins = " ".join(f"LEFT JOIN ({sql[k]}) AS {k} USING (lead_id)" for k in parts)
    return f"SELECT lead_id, {names} FROM (SELECT DISTINCT o_custkey AS lead_id FROM orders) AS o {joins}"


SQL = {
    "s11_response_log": "SELECT o_custkey AS lead_id, CASE WHEN o_custkey % 5 = 0 THEN 'SUCCESS_NO_HIT' ELSE 'SUCCESS_MATCHED' END AS status, CASE WHEN o_custkey % 5 <> 0 THEN count(*) END AS n_accounts FROM orders GROUP BY o_custkey",
    "b2_account_type": ACCOUNTS_SQL + f" SELECT o_orderkey, {_BUCKET} AS bucket FROM accs",
    "b3_is_active": ACCOUNTS_SQL + " SELECT o_orderkey, status = 'Current Account' AS active FROM accs",
    "b4_institution": ACCOUNTS_SQL + f" SELECT o_orderkey, {_CATEGORY} AS category FROM accs",
    "b5_segment": ACCOUNTS_SQL + f" SELECT o_orderkey, {_SEGMENT} AS segment FROM accs",
    "b6_portfolio": _per(
        {
            "total_accounts": "count(*)", "active_accounts": "count(*) FILTER (active)", "active_pct": _pct("count(*) FILTER (active)", "count(*)"), "closed_accounts": "count(*) FILTER (NOT active)",
            "closed_pct": _pct("count(*) FILTER (NOT active)", "count(*)"), "settled_accounts": "count(*) FILTER (status = 'Settled')", "writtenoff_or_settled_pct": _pct("count(*) FILTER (status = 'Settled')", "count(*)"),
        }
    ),
    "b7_ages": _P + f""", l AS (SELECT *, max(reported) OVER (PARTITION BY lead_id) AS last FROM p) SELECT lead_id, CAST(max({_AGE}) AS INTEGER) AS oldest_account_age_months, CAST(min({_AGE}) AS INTEGER) AS newest_account_age_months,
      round(avg({_AGE}), 4) AS average_account_age_months FROM l GROUP BY 1""",
    "b8_amounts": _per(
        {
            "total_credit_limit": _sum("credit_limit"), "total_active_credit_limit": _sum("credit_limit", "active"), "total_sanction_amount": _sum("sanction"), "total_active_sanction_amount": _sum("sanction", "active"),
            "total_balance_amount": _sum("balance"), "total_monthly_payment_amount": _sum("installment"),
        }
    ),
    "b9_bucket_counts": _per(
        {f"num_{b}": f"count(*) FILTER (bucket = '{b}')" for b in C.BUCKETS} | {f"active_count_{b}": f"count(*) FILTER (active AND bucket = '{b}')" for b in C.BUCKETS}
        | {f"total_count_institution_segment_{n}": f"count(*) FILTER (segment = '{s}')" for s, n in C.SEGMENTS.items()} | {f"active_count_institution_segment_{n}": f"count(*) FILTER (active AND segment = '{s}')" for s, n in C.SEGMENTS.items()}
        | {"total_count_institution_category_psu_bank": "count(*) FILTER (category = 'PSU Bank')"}
    ),
    "b10_is_premium": _per({"is_premium": "CASE WHEN bool_or(active AND segment = 'Premium') THEN 'Premium' WHEN bool_or(active AND segment = 'Mainstream') THEN 'Mainstream' END"}),
    "b11_diversity": _per({"credit_diversity_index": "round((1 - (" + " + ".join(f"pow(count(*) FILTER (bucket = '{b}') / count(*), 2)" for b in C.BUCKETS) + ")) * 100, 4)"}),
    "b12_shares": _per(
        {f"pct_of_total_sanctioned_amount_{B.short(b)}": _share("sanction", b) for b in B.SANCTION_SHARES} | {f"pct_of_total_sanctioned_amount_active_{B.short(b)}": _share("sanction", b, "active") for b in B.SANCTION_SHARES}
        | {f"pct_of_total_balance_amount_active_{B.short(b)}": _share("balance", b, "active") for b in B.BALANCE_SHARES} | {f"pct_of_total_installment_amount_active_{B.short(b)}": _share("installment", b, "active") for b in B.INSTALLMENT_SHARES}
    ),
    "b13_suits": _per({"suit_filed_status_values": "coalesce(string_agg(DISTINCT suit, '|' ORDER BY suit) FILTER (suit <> '*'), '')"}),
    "b14_person": _P + """ SELECT lead_id, CASE WHEN lead_id % 10 <> 1 THEN CAST(300 + lead_id % 600 AS DOUBLE) END AS score, '120' AS summary_most_severe_status_with_in24_months, CAST(lead_id % 4 AS VARCHAR) AS summary_no_of_past_due_accounts,
      CAST(0 AS BIGINT) AS reason_count_utilization, CAST(lead_id % 3 = 1 AS BIGINT) AS reason_count_delinquency_default, CAST(0 AS BIGINT) AS reason_count_credit_exposure_unsecured_debt, CAST(0 AS BIGINT) AS reason_count_portfolio_composition,
      CAST(lead_id % 3 = 0 AS BIGINT) AS reason_count_credit_history_vintage_activity, CASE WHEN lead_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
      CAST(((year(max(reported)) - 1980) * 12 + month(max(reported)) - 6) // 12 AS BIGINT) AS age_years, lead_id % 2 = 0 AS has_pan, FALSE AS has_passport, TRUE AS has_voter_id FROM p GROUP BY lead_id""",
    "b14_unmapped_reasons": "SELECT 'Something new' AS description, count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey % 5 <> 0 AND o_custkey % 3 = 2",
    "b15_flat_features": _FLATS + " SELECT lead_id, crif_score, crif_total_accounts, crif_active_accounts, crif_overdue_accounts, crif_total_outstanding, crif_credit_history_months FROM f",
    "j1_assemble": _JOINED + " SELECT * FROM j",
    "d6_source_frame": _FLATS + " SELECT lead_id, status AS crif_match_status, 'b0' AS crif_batch_id, crif_total_accounts IS NOT NULL AS crif_is_enriched FROM f",
    "p5_enriched_mask": _FLATS + " SELECT lead_id, crif_score IS NOT NULL OR crif_credit_history_months IS NOT NULL AS enriched FROM f",
    "w9_latest_runs": _LOG + ", r AS (SELECT source, run_id, min(fetched_at) AS s FROM log GROUP BY 1, 2) SELECT source, run_id FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY s DESC, run_id) = 1",
    "j2_repeated_responses": _LOG + " SELECT run_id, lead_id, count(*) AS n FROM log GROUP BY 1, 2 HAVING count(*) > 1",
    "a20_run_summary": _LOG + " " + _SUMMARY,
    "a21_coverage": _LOG + f", s AS ({_SUMMARY}), u AS (SELECT * FROM s UNPIVOT (n FOR status IN (matched, no_hit, error, not_sent))) SELECT run_id, status, n, round(100 * (n / rows_attempted), 1) AS pct, status = 'matched' AND NOT (n / rows_attempted BETWEEN 0.35 AND 0.43) AS unusual FROM u",
    "a22_coverage_by_level": _JOINED + """, l AS (SELECT 'crif' AS source, c_mktsegment AS level, avg(CAST(crif_is_enriched AS INTEGER)) AS rate FROM j GROUP BY 2 UNION ALL SELECT 'equifax', c_mktsegment, avg(CAST(equifax_is_enriched AS INTEGER)) FROM j GROUP BY 2)
      SELECT source, level, round(rate, 6) AS rate, max(rate) OVER (PARTITION BY source) - min(rate) OVER (PARTITION BY source) > 0.15 AS spread_flag FROM l""",
    "a23_batch_invariants": _LOG + """, r AS (SELECT source, run_id, count(*) AS n, count(*) FILTER (status = 'SUCCESS_MATCHED') AS m, CAST(epoch(date_trunc('second', max(fetched_at))) - epoch(date_trunc('second', min(fetched_at))) AS BIGINT) AS spread_seconds FROM log GROUP BY 1, 2),
      d AS (SELECT run_id, count(*) FILTER (k > 1) AS n_repeated FROM (SELECT run_id, lead_id, count(*) AS k FROM log GROUP BY 1, 2) GROUP BY 1)
      SELECT run_id, n_repeated, run_id <> 'run3' AS counts_agree, spread_seconds FROM r JOIN d USING (run_id) WHERE source IN (SELECT source FROM r GROUP BY 1 HAVING count(*) > 1)""",
    "j3_timing_leaks": _LOG + """, o AS (SELECT user_id AS lead_id, min(ts) AS outcome_at FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT lead_id, rtrim(rtrim(strftime(fetched_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS fetched_at,
      rtrim(rtrim(strftime(outcome_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS outcome_at FROM log JOIN o USING (lead_id) WHERE fetched_at > outcome_at""",
    "a33_formula_consistency": _FORMULA("l_returnflag", "l_linenumber <> 3"),
    "v3_le_invariant": _FORMULA("l_linestatus", "l_discount <= l_tax + 1e-6"),
}
SQL["b1_all_features"] = _everything(SQL)
