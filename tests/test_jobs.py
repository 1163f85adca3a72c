from tests.builders import applicant, table
import time

import pytest
from pyspark.sql import functions as F

from creditloom import fixed as X
from creditloom.operators import retrieve
from creditloom.plans import billing, jobs
from creditloom.session import tidy
from creditloom.streaming import requests as stream


@pytest.fixture(scope="module")
def store(spark):
    text = "Terms. " * 30 + "\nREGULATION R-8\nexposure limits on clean credit cards\nREGULATION O-1\ncomplaint handling"
    return jobs.chunk_store(spark.createDataFrame([(1, text)], "doc_id long, text string")).cache()


@pytest.fixture(scope="module")
def people(spark):
    late = {c: 3 for c in X.STATUS_COLUMNS}
    return table(
        spark, applicant(1), applicant(2, LIMIT_BAL=2_500_000.0, **late), applicant(3, LIMIT_BAL=6_000_000.0),
        applicant(4, LIMIT_BAL=0.0, EDUCATION=0, **late), applicant(5, LIMIT_BAL=None, AGE=10), applicant(6)).cache()


def test_every_applicant_gets_a_report(people, store):
    rows = {r[X.KEY]: r for r in jobs.underwrite(people, store).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6]
    assert rows[3]["compliance_question"] == X.QUESTION_AGGREGATE
    assert rows[2]["compliance_question"] == X.QUESTION_CLEAN
    assert rows[4]["compliance_question"].endswith("credit limit 0.0?")
    assert rows[5]["compliance_question"].endswith("credit limit N/A?")
    assert rows[4]["EDUCATION"] == 4 and X.WARN_EDUCATION in rows[4]["data_warnings"]
    assert rows[1]["compliance_answer"] == rows[6]["compliance_answer"]
    for r in rows.values():
        assert len(r["compliance_sources"]) == 3 and len(r["top_risk_factors"]) == 5
        assert r["compliance_answer"] in r["final_report"] and r["final_report"].startswith("\n" + "=" * 55)
    assert "   None" in rows[1]["final_report"].splitlines()
    assert f"   Decision            : {rows[4]['risk_decision']}" in rows[4]["final_report"]


def test_the_driver_lets_go_of_what_nothing_refers_to(spark, people, store, monkeypatch):
    jvm, told = spark._jvm, []
    left = jvm.java.lang.ref.WeakReference(jvm.java.lang.Object())
    for _ in range(20):  # Python tells the JVM a little later what it has let go of
        tidy(spark)
        if left.refersTo(None):
            break
        time.sleep(0.5)
    assert left.refersTo(None)
    monkeypatch.setattr(jobs, "tidy", told.append)
    jobs.underwrite(people, store)
    assert len(told) == 2  # before the search, and when the answers are written


def test_citations_are_looked_for_once_per_question(spark, people):
    """What the report cites beyond its sources, without a search of every applicant's report."""
    texts = ["See Regulation  R-99. " * 10 + "\nREGULATION R-8\nas in regulation o-7 and REGULATION R-8 and REGULATION", "REGULATION O-3\nregulation\nr-8 " * 20]
    store = jobs.chunk_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    decided = jobs.underwrite(people, store)
    direct = retrieve.unsupported_citations(F.col("final_report"), F.col("compliance_sources"))
    rows = decided.select("unsupported", direct.alias("direct")).collect()
    assert any(r["direct"] for r in rows) and all(r["unsupported"] == r["direct"] for r in rows)
    text = decided.select(X.KEY, "unsupported")._jdf.queryExecution().optimizedPlan().toString()
    assert "CREDIT UNDERWRITING REPORT" not in text
    assert "_uncovered" not in decided.columns


def test_a_given_question_comes_before_the_template(people, store):
    rows = jobs.underwrite(people, store, given=F.lit("What does R-8 say?")).collect()
    asked = {r[X.KEY]: r for r in rows}
    assert asked[1]["compliance_question"] == "What does R-8 say?"
    assert asked[1]["compliance_sources"] == ["REGULATION R-8"]
    assert asked[3]["compliance_question"] == X.QUESTION_AGGREGATE


def test_stream_decides_like_the_batch_and_once(spark, people, store, tmp_path):
    source, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    means = jobs.portfolio_means(people)
    arriving = people.select(
        F.col(X.KEY).alias("request_id"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("request_ts"),
        X.KEY, *X.BASE_COLUMNS)

    def run():
        stream.underwrite_stream(stream.read_requests(spark, source, 1), store, log, check, means).awaitTermination()
        return stream.read_log(spark, log)

    arriving.filter("request_id <= 3").coalesce(1).write.mode("append").parquet(source)
    assert run().count() == 3
    arriving.filter("request_id > 3").coalesce(1).write.mode("append").parquet(source)
    logged = run()
    assert logged.count() == 6 and run().count() == 6
    keep = [X.KEY, "risk_probability", "risk_decision", "compliance_question", "compliance_answer", "top_risk_factors"]
    batch = jobs.underwrite(people, store, means=means).select(*keep)
    assert logged.select(*keep).exceptAll(batch).count() == 0 and logged.select(X.KEY).distinct().count() == 6


def test_feature_job_writes_both_parts(spark, small, tmp_path):
    path = str(tmp_path / "features")
    people = billing.applicants(spark, small)
    jobs.feature_job(people, path)
    parts = {r["split"]: r["count"] for r in spark.read.parquet(path).groupBy("split").count().collect()}
    assert sum(parts.values()) == people.count() and set(parts) == {"train", "test"}


def test_a_customer_with_most_orders_is_one_applicant(spark, tmp_path):
    """A third of all orders belongs to one customer; only the latest seven count."""
    orders = spark.range(3000).select(
        F.col("id").alias("o_orderkey"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 200 + 2).cast("long").alias("o_custkey"),
        F.lit(100.0).alias("o_totalprice"),
        F.expr("make_timestamp_ntz(2000, 1, 1, 0, 0, 0) + make_dt_interval(cast(id as int))").alias("o_orderdate"))
    lines = orders.select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit("F").alias("l_linestatus"),
        F.col("o_totalprice").alias("l_extendedprice"),
        (F.col("o_orderdate") + F.expr("make_dt_interval(65)")).alias("l_shipdate"))
    customers = spark.range(1, 202).select(
        F.col("id").alias("c_custkey"), F.lit(10.0).alias("c_acctbal"), F.lit(1).alias("c_nationkey"))
    for name, df in (("orders", orders), ("lineitem", lines), ("customer", customers)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = {r[X.KEY]: r for r in billing.applicants(spark, str(tmp_path)).collect()}
    assert rows[1]["PAY_0"] == 0 and rows[1]["PAY_AMT6"] == 100.0 and rows[1]["target"] == 0
    assert len(rows) == len(set(rows))


def test_arriving_requests_are_dealt_out_by_their_number(spark, tmp_path):
    """Not in a fixed number of files, which would be tasks that grow with the input."""
    from checks.queries import _arriving
    from creditloom import fixed as X

    people = spark.range(500).select(F.col("id").alias(X.KEY), *[F.lit(1).alias(name) for name in X.BASE_COLUMNS])
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        _arriving(spark, people, str(tmp_path / "r"))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(list((tmp_path / "r").glob("part-*.parquet"))) > 3
    assert spark.read.parquet(str(tmp_path / "r")).count() == 500
