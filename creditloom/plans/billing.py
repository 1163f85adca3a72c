"""Wide applicant history from orders and their lines.

Raw billing data is long: one order is one statement. The operators expect one
row per applicant with six numbered months, so this is the step in front of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed as X
from ..sources.readers import load

MONEY = "decimal(14,2)"
MONTHS = 7  # the outcome month (0) and six months of history
CENTS_PER_POINT = 600  # account balance to credit limit


def _statements(orders: DataFrame) -> DataFrame:
    """The latest seven orders per customer, 0 = latest.

    The rank filter is applied before the shuffle as well, so a customer with a
    large share of all orders sends at most seven rows per task.
    """
    latest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return (
        orders.select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").cast(MONEY).alias("bill"))
        .withColumn("rank", F.row_number().over(latest))
        .filter(F.col("rank") <= MONTHS)
        .withColumn("m", F.col("rank") - 1)
        .drop("rank")
    )


def _payments(lineitem: DataFrame) -> DataFrame:
    paid = F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice").cast(MONEY)).otherwise(F.lit(0).cast(MONEY))
    return lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"), F.sum(paid).alias("paid"))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer, month, bill, paid, status) for the latest seven statements."""
    statements = _statements(load(spark, sf_dir, "orders"))
    payments = _payments(load(spark, sf_dir, "lineitem"))
    lag_days = F.date_diff(F.col("shipped"), F.col("o_orderdate"))
    delay = F.floor(lag_days / 30.0).cast("int") - 2
    status = F.when(F.col("shipped").isNull(), -2).otherwise(F.least(F.lit(8), F.greatest(F.lit(-1), delay)))
    return statements.join(payments, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_custkey", "m", "bill",
        F.coalesce("paid", F.lit(0).cast(MONEY)).alias("paid"),
        status.alias("pay"),
    )


def _month(value: str, m: int) -> Column:
    return F.max(F.when(F.col("m") == m, F.col(value)))


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """applicant_id, 23 raw columns and the target."""
    history = {}
    for m, (status, bill, paid) in enumerate(zip(X.STATUS_COLUMNS, X.BILL_COLUMNS, X.PAID_COLUMNS), 1):
        history[status] = _month("pay", m).cast("int")
        history[bill] = _month("bill", m).cast("double")
        history[paid] = _month("paid", m).cast("double")
    late_now = F.max(F.when((F.col("m") == 0) & (F.col("pay") >= 1), 1).otherwise(0))
    wide = (
        months(spark, sf_dir).groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n_months"), late_now.alias("late_now"),
             *[value.alias(name) for name, value in history.items()])
        .filter(F.col("n_months") == MONTHS)
    )
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    key = F.col("c_custkey")
    profile = {
        "LIMIT_BAL": (F.col("c_acctbal").cast(MONEY) * CENTS_PER_POINT).cast("double"),
        "SEX": (1 + key % 2).cast("int"),
        "EDUCATION": (F.col("c_nationkey") % 7).cast("int"),
        "MARRIAGE": (key % 4).cast("int"),
        "AGE": (15 + key % 90).cast("int"),
    }
    target = F.when((F.col("late_now") == 1) | (F.col("c_acctbal") < 0), 1).otherwise(0)
    return customer.join(wide, F.col("c_custkey") == F.col("o_custkey")).select(
        key.alias(X.KEY), *[value.alias(name) for name, value in profile.items()],
        *X.STATUS_COLUMNS, *X.BILL_COLUMNS, *X.PAID_COLUMNS, target.alias(X.TARGET),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label by itself: late on the latest statement, or a negative balance."""
    latest = months(spark, sf_dir).filter(F.col("m") == 0)
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return customer.join(latest, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").alias(X.KEY),
        F.when((F.col("pay") >= 1) | (F.col("c_acctbal") < 0), 1).otherwise(0).alias(X.TARGET),
    )
