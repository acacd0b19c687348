"""Features of bureau responses: nested JSON to one flat row per response.

The accounts of a response are aggregated by (run_id, lead_id) with conditional sums,
which Spark combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelforge.functions import bureau as B
from funnelforge.functions.scalars import number, timestamp

#: The shape that is read; leaves are text, whatever else a report holds.
REPORT = """struct<
  retailAccountDetails:array<struct<accountType:string,institution:string,creditLimit:string,sanctionAmount:string,installmentAmount:string,
    balance:string,accountStatus:string,dateReported:string,dateOpened:string,history48Months:array<struct<suitFiledStatus:string>>>>,
  retailAccountsSummary:struct<mostSevereStatusWithIn24Months:string,noOfPastDueAccounts:string>,
  scoreDetails:array<struct<value:string,scoringElements:array<struct<description:string>>>>,
  iDAndContactInfo:struct<personalInfo:struct<gender:string,dateOfBirth:string>,identityInfo:struct<pANId:string,nationalIDCard:string,otherId:string>>>"""
PAYLOAD = f"struct<data:struct<cCRResponse:struct<cIRReportDataLst:array<struct<cIRReportData:{REPORT}>>>>>".replace("\n", "").replace("  ", "")

# Which shares of amounts are features.
SANCTION_SHARES = [b for b in B.BUCKETS if b not in ("credit_cards", "other_loans")]
BALANCE_SHARES = ["consumer_loans", "overdraft_accounts", "other_loans"]
INSTALLMENT_SHARES = ["gold_loans", "consumer_loans", "personal_loans", "property_loans", "business_loans", "vehicle_loans", "other_loans"]

# Descriptions of scoring elements by reason.
REASONS = {
    "utilization": ["Total Utilization", "Credit Card Utilization", "Kisan Credit Card Utilization"],
    "delinquency_default": [
        "Delinquency Presence", "Overdue Amount", "Occurances of default account", "Overdue Amount on Unsecured Trades", "Overdue amount Credit Card",
        "Occurances of delinquent account", "Sanction Amount on Derog trades",
    ],
    "credit_exposure_unsecured_debt": [
        "Total Credit Exposure", "Recent Credit exposure", "Balance On Unsecured Trade", "Percentage of Secure Trades",
        "Total credit exposure of Unsecured Loan",
    ],
    "portfolio_composition": [
        "Non Retail Trades", "Number of Home Loans", "Number of Personal Loans", "Number of Gold Loans", "Number of Credit Cards",
        "Number of live Consumer Durables loans",
    ],
    "credit_history_vintage_activity": [
        "Vintage in Bureau", "No Live Accounts", "Limited Credit History", "Recent Closed Accounts", "No Active Accounts",
        "Insufficient information to score", "Earlier Closed Accounts", "Not Applicable", "Installment loan opened recently",
    ],
}
MATCHED = "SUCCESS_MATCHED"

#: Scores that are reason codes of the flat bureau.
FLAT_CODES = [0, *range(10, 19)]


def parsed(responses: DataFrame) -> DataFrame:
    """(run_id, lead_id, status, report) of a response log. A sub-tree of another
    shape is null while its siblings stay; only matched responses are parsed."""
    payload = F.from_json("payload_json", PAYLOAD)
    report = F.get(payload["data"]["cCRResponse"]["cIRReportDataLst"], 0)["cIRReportData"]
    return responses.select("run_id", "lead_id", "status", F.when(F.col("status") == MATCHED, report).alias("report"))


def accounts(reports: DataFrame) -> DataFrame:
    """One row per account, classified; null entries are dropped."""
    rows = reports.where("report is not null").select("run_id", "lead_id", F.explode("report.retailAccountDetails").alias("a")).where("a is not null")
    # Names of its own, so that each is worked out once: what reads them does so several times.
    rows = rows.withColumns({"status": B.status(F.col("a.accountStatus")), "category": B.institution(F.col("a.institution"))})
    category = F.col("category")
    return rows.select(
        "run_id", "lead_id", B.account_type(F.col("a.accountType")).alias("bucket"), (~F.col("status").isin(B.CLOSED)).alias("active"),
        "status", category, B.segment(category, F.col("a.institution")).alias("segment"),
        B.amount(F.col("a.creditLimit")).alias("credit_limit"), B.amount(F.col("a.sanctionAmount")).alias("sanction"),
        B.amount(F.col("a.installmentAmount")).alias("installment"), B.amount(F.col("a.balance")).alias("balance"),
        timestamp(F.col("a.dateReported")).alias("reported"), timestamp(F.col("a.dateOpened")).alias("opened"),
        F.col("a.history48Months").alias("history"),
    )


def months_between(later: Column, earlier: Column) -> Column:
    """Whole calendar months."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def pct(part: Column, whole: Column) -> Column:
    """A percentage at four places; null where the whole is 0."""
    return F.round(F.try_divide(100.0 * part, F.nullif(whole.cast("double"), F.lit(0.0))), 4)


KEYS = ["run_id", "lead_id"]


def _portfolio_sums() -> dict[str, Column]:
    n = lambda cond: F.count(F.when(cond, 1))
    total = lambda c, cond=None: F.coalesce(F.sum(F.when(cond, F.col(c)) if cond is not None else F.col(c)), F.lit(0.0))
    active, bucket, seg = F.col("active"), F.col("bucket"), F.col("segment")
    sums = {
        "total_accounts": F.count(F.lit(1)), "active_accounts": n(active), "closed_accounts": n(~active), "settled_accounts": n(F.col("status").isin(B.SETTLED)),
        "_written": n(F.col("status").isin(B.WRITTEN_OFF)), "total_credit_limit": total("credit_limit"), "total_active_credit_limit": total("credit_limit", active),
        "total_sanction_amount": total("sanction"), "total_active_sanction_amount": total("sanction", active), "total_balance_amount": total("balance"),
        "_active_balance": total("balance", active), "total_monthly_payment_amount": total("installment"), "_active_installment": total("installment", active),
        "total_count_institution_category_psu_bank": n(F.col("category") == "PSU Bank"),
    }
    for b in B.BUCKETS:
        sums |= {f"num_{b}": n(bucket == b), f"active_count_{b}": n(active & (bucket == b))}
    for s, name in B.SEGMENTS.items():
        sums |= {f"total_count_institution_segment_{name}": n(seg == s), f"active_count_institution_segment_{name}": n(active & (seg == s))}
    sums |= {f"_s_{b}": total("sanction", bucket == b) for b in SANCTION_SHARES} | {f"_sa_{b}": total("sanction", active & (bucket == b)) for b in SANCTION_SHARES}
    sums |= {f"_b_{b}": total("balance", active & (bucket == b)) for b in BALANCE_SHARES} | {f"_i_{b}": total("installment", active & (bucket == b)) for b in INSTALLMENT_SHARES}
    return sums


def _portfolio_rest() -> dict[str, Column]:
    """What derives from the sums."""
    share = lambda b: F.pow(F.col(f"num_{b}") / F.col("total_accounts"), 2)
    more = {
        "active_pct": pct(F.col("active_accounts"), F.col("total_accounts")), "closed_pct": pct(F.col("closed_accounts"), F.col("total_accounts")),
        "writtenoff_or_settled_pct": pct(F.col("_written"), F.col("total_accounts")),
        "is_premium": F.when(F.col("active_count_institution_segment_premium") > 0, "Premium").when(F.col("active_count_institution_segment_mainstream") > 0, "Mainstream"),
        "credit_diversity_index": F.round((1 - sum((share(b) for b in B.BUCKETS), F.lit(0.0))) * 100, 4),
    }
    more |= {f"pct_of_total_sanctioned_amount_{short(b)}": pct(F.col(f"_s_{b}"), F.col("total_sanction_amount")) for b in SANCTION_SHARES}
    more |= {f"pct_of_total_sanctioned_amount_active_{short(b)}": pct(F.col(f"_sa_{b}"), F.col("total_active_sanction_amount")) for b in SANCTION_SHARES}
    more |= {f"pct_of_total_balance_amount_active_{short(b)}": pct(F.col(f"_b_{b}"), F.col("_active_balance")) for b in BALANCE_SHARES}
    more |= {f"pct_of_total_installment_amount_active_{short(b)}": pct(F.col(f"_i_{b}"), F.col("_active_installment")) for b in INSTALLMENT_SHARES}
    return more


def _age_sums() -> dict[str, Column]:
    return {"_last": F.max("reported"), "_o1": F.min("opened"), "_o2": F.max("opened"), "_all": F.collect_list("opened")}


def _age_rest() -> dict[str, Column]:
    last = F.col("_last")
    each = F.transform("_all", lambda o: F.greatest(F.lit(0), months_between(last, o)))
    mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("_all"), F.lit(0))
    age = lambda c: F.greatest(F.lit(0), months_between(last, F.col(c)))
    known = last.isNotNull() & F.col("_o1").isNotNull()
    return {
        "oldest_account_age_months": F.when(known, age("_o1")), "newest_account_age_months": F.when(known, age("_o2")),
        "average_account_age_months": F.when(known, F.round(mean, 4)), "last": last,
    }


def _suit_sums() -> dict[str, Column]:
    # Only values that tell something are collected: a response has few.
    values = F.filter(F.transform(F.coalesce("history", F.array()), lambda h: F.trim(h["suitFiledStatus"])), lambda v: v.isNotNull() & ~v.isin("", "*"))
    return {"_suits": F.collect_set(F.when(F.size(values) > 0, F.array_sort(F.array_distinct(values))))}


def _suit_rest() -> dict[str, Column]:
    return {"suit_filed_status_values": F.array_join(F.array_sort(F.array_distinct(F.flatten("_suits"))), "|")}


def _summed(accs: DataFrame, sums: dict[str, Column], rest: dict[str, Column]) -> DataFrame:
    found = accs.groupBy(*KEYS).agg(*(c.alias(k) for k, c in sums.items())).withColumns(rest)
    return found.drop(*(c for c in found.columns if c.startswith("_")))


def portfolio(accs: DataFrame) -> DataFrame:
    """Per response its counts, amounts, shares, segments and diversity."""
    return _summed(accs, _portfolio_sums(), _portfolio_rest())


def ages(accs: DataFrame) -> DataFrame:
    """Oldest, newest and mean account age in months up to the response's latest report."""
    return _summed(accs, _age_sums(), _age_rest())


def suits(accs: DataFrame) -> DataFrame:
    """The distinct suit values of all histories, sorted; '' if there are none."""
    return _summed(accs, _suit_sums(), _suit_rest())


def account_features(accs: DataFrame) -> DataFrame:
    """B6 to B13 in one aggregation."""
    return _summed(accs, _portfolio_sums() | _age_sums() | _suit_sums(), _portfolio_rest() | _age_rest() | _suit_rest())


def reason_of(c: Column) -> Column:
    t = F.lower(F.trim(c))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for bucket, texts in REASONS.items():
        chain = chain.when(t.isin([x.strip().lower() for x in texts]), bucket)
    return chain


def _is(value: str):
    return lambda x: x == value


def short(bucket: str) -> str:
    """A bucket's name in the names of shares."""
    return bucket.removesuffix("_loans").removesuffix("_accounts")


def person(reports: DataFrame, found: DataFrame) -> DataFrame:
    """Score, summary, reasons and identity of each response with a report, and the
    columns of ``found`` (run_id, lead_id, last) beyond ``last``."""
    r = F.col("report")
    elements = F.coalesce(F.get(r["scoreDetails"], 0)["scoringElements"], F.array())
    names = F.transform(elements, lambda e: reason_of(e["description"]))
    score = number(F.get(r["scoreDetails"], 0)["value"])
    has = lambda c: ~F.coalesce(c, F.lit("")).isin("", "[]", "{}", "0", "false", "null")
    ids, info = r["iDAndContactInfo"]["identityInfo"], r["iDAndContactInfo"]["personalInfo"]
    born = timestamp(info["dateOfBirth"])
    met = reports.where(r.isNotNull()).withColumns({"_names": names, "_born": born}).join(found, KEYS, "left")
    age = F.floor(F.greatest(F.lit(0), months_between(F.col("last"), F.col("_born"))) / 12)
    return met.select(
        "run_id", "lead_id", F.when(score != -1, score).alias("score"), r["retailAccountsSummary"]["mostSevereStatusWithIn24Months"].alias("summary_most_severe_status_with_in24_months"),
        r["retailAccountsSummary"]["noOfPastDueAccounts"].alias("summary_no_of_past_due_accounts"),
        *(F.size(F.filter("_names", _is(k))).cast("long").alias(f"reason_count_{k}") for k in REASONS),
        info["gender"].alias("gender"), F.when(F.col("last").isNotNull() & F.col("_born").isNotNull(), age).alias("age_years"),
        has(ids["pANId"]).alias("has_pan"), has(ids["nationalIDCard"]).alias("has_passport"), has(ids["otherId"]).alias("has_voter_id"),
        *(c for c in found.columns if c not in (*KEYS, "last")),
    )


def unmapped_reasons(reports: DataFrame) -> DataFrame:
    """(description, n) of scoring elements that no reason has."""
    elements = F.explode(F.get(F.col("report.scoreDetails"), 0)["scoringElements"])
    rows = reports.where("report is not null").select(elements.alias("e")).select(F.trim("e.description").alias("description")).where("description is not null")
    return rows.where(reason_of(F.col("description")).isNull()).groupBy("description").agg(F.count(F.lit(1)).alias("n"))


def features(responses: DataFrame, prefix: str = "equifax_") -> DataFrame:
    """One row per response with all features, null unless it matched with a report.

    A report without accounts has counts of 0 and null shares, ages and amounts.
    """
    reports = parsed(responses)
    found = account_features(accounts(reports))
    counts = [c for c, t in found.dtypes if t == "bigint" and c not in KEYS]
    out = person(reports, found)
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    named = out.select(*KEYS, *(F.col(c).alias(prefix + c) for c in out.columns if c not in KEYS))
    return responses.select(*KEYS).join(named, KEYS, "left")


def flat_features(responses: DataFrame, prefix: str = "crif_") -> DataFrame:
    """The flat bureau's features: score without reason codes, four passthroughs and
    the credit history in months."""
    flat = "struct<score:string,total_accounts:string,active_accounts:string,overdue_accounts:string,total_outstanding:string,credit_history_length_text:string>"
    p = F.when(F.col("status") == MATCHED, F.from_json("payload_json", flat))
    rows = responses.select("run_id", "lead_id", p.alias("p"))
    value = lambda c: number(F.col(f"p.{c}"))
    text = F.trim(F.col("p.credit_history_length_text"))
    pattern = r"(?i)^([0-9]+)\s*yrs?\s+([0-9]+)\s*mon$"
    months = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1).cast("int") * 12 + F.regexp_extract(text, pattern, 2).cast("int"))
    score = value("score")
    return rows.select(
        "run_id", "lead_id", F.when(~score.isin(FLAT_CODES), score).alias(prefix + "score"),
        *(value(c).alias(prefix + c) for c in ("total_accounts", "active_accounts", "overdue_accounts", "total_outstanding")), months.alias(prefix + "credit_history_months"),
    )
