"""Column functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from funnelforge.functions import bureau as B
from funnelforge.functions import scalars as S


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_phone(spark):
    texts = ["7889358744.0", "+91-7889358744", "(788) 935-8744", "917889358744", " 7889358744 ", "12345", "", "   ", None, "7889358700"]
    assert values(spark, texts, S.phone) == ["7889358744"] * 5 + [None] * 4 + ["7889358700"]


def test_number(spark):
    texts = ["1", " 12 ", "1e3", "-.5", "5.", "inf", "nan", "1d", "1f", "abc", "", None, "1,000"]
    assert values(spark, texts, S.number) == [1.0, 12.0, 1000.0, -0.5, 5.0, float("inf"), None, None, None, None, None, None, None]


def test_durations_and_bands(spark):
    texts = ["6yrs 0mon", "0yrs 6mon", "2 years 3 months", "1yr", "6mon", "6 minutes", "5", "garbage", "about 2 years", "", None]
    assert values(spark, texts, S.duration_months) == [72, 6, 27, 12, 6, 6, None, None, None, None, None]
    bands = values(spark, ["0", "5", "6", "72", None], lambda c: S.duration_band(c.cast("int")))
    assert bands == ["0-6", "0-6", "6-12", "60+", None]


def test_timestamps(spark):
    texts = ["15/03/2024", "5/3/2024", "2024-03-05", "2024-01-15", "30 Apr 2026", "05-03-2024", "99/99/2024", "", None]
    day = [str(v)[:10] if v else None for v in values(spark, texts, S.timestamp)]
    assert day == ["2024-03-15", "2024-03-05", "2024-03-05", "2024-01-15", "2026-04-30", "2024-03-05", None, None, None]
    assert str(values(spark, ["3/15/2024"], lambda c: S.timestamp(c, False))[0])[:10] == "2024-03-15"


def test_blank(spark):
    assert values(spark, [None, "", " \t\n", "x", "nan"], S.is_blank) == [True, True, True, False, False]


@pytest.mark.parametrize(
    ("text", "bucket"),
    [("Credit Card", "credit_cards"), ("Kisan Credit Card", "business_loans"), ("Loan on Credit Card", "other_loans"), ("GOLD-LOAN", "gold_loans"), ("Housing  Loan", "home_loans"), ("Two-Wheeler Loan", "vehicle_loans"), (None, "other_loans"), ("", "other_loans")],
)
def test_account_types(spark, text, bucket):
    assert values(spark, [text], B.account_type) == [bucket]


def test_institutions_and_segments(spark):
    names = ["State Bank of India", "HDFC Bank", "Citibank N.A.", "Arcil", "KreditBee", "Muthoot Finance", "Bajaj Finance Ltd", "Some Bank", "Xfin", "Zed", "", None]
    category = values(spark, names, B.institution)
    assert category == ["PSU Bank", "Private Bank", "Foreign Bank", "Asset Reconstruction Company", "Fintech / Digital Lender", "NBFC", "NBFC", "Private Bank", "NBFC", B.UNCLASSIFIED, B.UNCLASSIFIED, B.UNCLASSIFIED]
    segment = values(spark, names, lambda c: B.segment(B.institution(c), c))
    assert segment[:9] == ["Mainstream", "Mainstream", "Premium", "Distressed", "Mass Market - Digital", "Mass Market - Secured", "Mass Market - Digital", "Mainstream", "Mass Market - General NBFC"]


def test_active_and_amounts(spark):
    assert values(spark, ["Closed  Account", "SETTLED", "Delinquent", None, ""], B.is_active) == [False, False, True, True, True]
    assert values(spark, ["1,00,000", " 5 ", "", None, "x"], B.amount) == [100000.0, 5.0, 0.0, 0.0, 0.0]


def test_dates_of_other_shapes_are_not_tried_but_none_is_lost(spark):
    days = ["2024-1-5", "2024-01-05", "5/1/2024", "05/01/2024", "5-1-2024", "5.1.2024", "5 Jan 2024", "12024-01-05", "+12024-1-5", "24-1-5", "2024/1/5", "5 jan 2024", "1-2-3-4", "5.1", "", " 5/1/2024\n"]
    texts = [d + t for d in days for t in ("", " 10:20:30", " 10:20", " 1:2:3", "T10:20:30", "x")] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = lambda forms: F.coalesce(*(F.try_to_timestamp(S.trimmed(F.col("t")), F.lit(f)) for f in forms))
    for first, forms in ((True, S.DAY_FIRST), (False, S.MONTH_FIRST)):
        rows = df.select(S.timestamp(F.col("t"), first).cast("string").alias("a"), plain(forms).cast("string").alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows] and sum(r["a"] is not None for r in rows) > 10
