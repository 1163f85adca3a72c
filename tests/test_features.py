from tests.builders import applicant, table

from creditloom import fixed as X
from creditloom.operators import clean, features
from creditloom.operators.retrieve import plain_number
from pyspark.sql import functions as F


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


def bills(value):
    return {c: value for c in X.BILL_COLUMNS}


def test_limit_of_zero(spark):
    df = table(spark, applicant(LIMIT_BAL=0.0))
    assert one(df, features.utilization_ratio(0.0)) == 0.0
    assert one(df, features.utilization_ratio(None)) is None


def test_payment_ratio_without_positive_bills(spark):
    assert one(table(spark, applicant(**bills(0.0))), features.payment_ratio()) == 1.0
    assert one(table(spark, applicant(**bills(-5.0))), features.payment_ratio()) == 1.0
    assert one(table(spark, applicant()), features.payment_ratio()) == 0.5


def test_a_missing_status(spark):
    df = table(spark, applicant(PAY_0=3, PAY_3=None, PAY_6=1))
    assert one(df, features.avg_pay_delay()) is None
    assert one(df, features.max_pay_delay()) == 3
    assert one(df, features.months_late()) == 2
    assert one(df, features.delay_trend()) == 2


def test_recode_and_warnings(spark):
    df = table(spark, applicant(EDUCATION=None, MARRIAGE=0), applicant(2, EDUCATION=5, AGE=None, LIMIT_BAL=None))
    checked = clean.recode(clean.validate(df)).orderBy(X.KEY).collect()
    assert checked[0]["EDUCATION"] is None and checked[0]["MARRIAGE"] == 3
    assert checked[0]["data_warnings"] == [X.WARN_EDUCATION, X.WARN_MARRIAGE]
    assert checked[1]["EDUCATION"] == 4
    assert checked[1]["data_warnings"] == [X.WARN_LIMIT, X.WARN_AGE, X.WARN_EDUCATION]


def test_caps_are_strict(spark):
    df = table(spark, applicant(LIMIT_BAL=2_000_000.0), applicant(2, LIMIT_BAL=5_000_000.0),
               applicant(3, LIMIT_BAL=5_000_000.01))
    rows = df.select(clean.cap_flags().alias("f")).select("f.*").collect()
    assert [tuple(r) for r in rows] == [(False, False), (True, False), (True, True)]


def test_unknown_codes_get_the_unknown_label(spark):
    row = clean.with_labels(table(spark, applicant(SEX=7, EDUCATION=None))).first()
    assert (row["sex_label"], row["education_label"]) == ("Unknown", "Unknown")
    assert row["summary_line"] == "Unknown, 30 years old, Unknown, Married"


def test_history_is_oldest_first(spark):
    df = table(spark, applicant(**{c: float(i) for i, c in enumerate(X.BILL_COLUMNS, 1)}))
    rows = features.history(df).orderBy("month_no").collect()
    assert [r["bill"] for r in rows] == [6.0, 5.0, 4.0, 3.0, 2.0, 1.0]
    assert [r["month"] for r in rows] == X.MONTH_LABELS


def test_numbers_are_never_in_exponent_form(spark):
    values = [(12345678.0,), (1118304.5,), (0.25,), (-3.0,), (None,)]
    df = spark.createDataFrame(values, "v double").select(plain_number(F.col("v")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["12345678.0", "1118304.5", "0.25", "-3.0", None]
