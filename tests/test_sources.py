from tests.builders import applicant, table
import gzip
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom import fixed as X
from creditloom import schemas as S
from creditloom.operators.corpus import chunk
from creditloom.plans import jobs
from creditloom.sources import readers, writers


def test_csv_keeps_bad_lines(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    writers.write_csv(table(spark, applicant(1), applicant(2, AGE=None)), path)
    good = readers.read_applicants_csv(spark, path)
    assert [r[S.CORRUPT] for r in good.collect()] == [None, None]
    header = ",".join(S.APPLICANT.fieldNames())
    bad = tmp_path / "bad.csv"
    bad.write_text(header + "\n3,notanumber" + ",1" * 23 + "\n")
    row = readers.read_applicants_csv(spark, str(bad)).first()
    assert row["LIMIT_BAL"] is None and row[S.CORRUPT].startswith("3,notanumber")


def test_read_table_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    writers.write_csv(df, str(tmp_path / "t.csv"))
    assert readers.read_table(spark, str(tmp_path / "t.parquet")).collect() == df.collect()
    assert readers.read_table(spark, str(tmp_path / "t.csv"), df.schema).collect() == df.collect()
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "t.csv"))


def test_text_files_lose_their_front_matter(spark, tmp_path):
    (tmp_path / "one.txt").write_text(f"cover{X.FRONT_MATTER_END}\nREGULATION R-1\nbody\nof two lines")
    (tmp_path / "two.txt").write_text("no marker")
    rows = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.read_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"one.txt": "\nREGULATION R-1\nbody\nof two lines", "two.txt": "no marker"}
    sections = [r["section"] for r in chunk(readers.read_corpus(spark, str(tmp_path))).collect()]
    assert sections == ["REGULATION R-1"]


def test_chunk_store_round_trip_and_missing_store(spark, tmp_path):
    chunks = chunk(spark.createDataFrame([(1, "REGULATION R-1\nx")], "doc_id long, text string"))
    writers.write_chunks(chunks, str(tmp_path / "c"))
    assert readers.read_chunks(spark, str(tmp_path / "c")).collect() == chunks.collect()
    with pytest.raises(AnalysisException):
        readers.read_chunks(spark, str(tmp_path / "none")).count()


def test_corpus_job_keeps_an_existing_store(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([(1, "REGULATION R-1\nx")], "doc_id long, text string")
    assert jobs.corpus_job(docs, path).count() == 1
    more = docs.unionByName(spark.createDataFrame([(2, "REGULATION R-2\ny")], "doc_id long, text string"))
    assert jobs.corpus_job(more, path).count() == 1
    assert jobs.corpus_job(more, path, overwrite=True).count() == 2


def test_requests(spark):
    full = table(spark, applicant(1)).select(F.to_json(F.struct(*X.BASE_COLUMNS)).alias("body")).first()["body"]
    bodies = [(1, full), (2, full.replace('"AGE":30', '"AGE":"old"')), (3, '{"AGE": 30}'), (4, "not json"), (5, None)]
    df = spark.createDataFrame(bodies, "id int, body string")
    rows = {r["id"]: r for r in readers.parse_requests(df, "body").collect()}
    assert [rows[i]["valid"] for i in range(1, 6)] == [True, False, False, False, False]
    assert rows[1]["request"]["AGE"] == 30 and rows[3]["request"]["AGE"] == 30


def test_missing_fields(spark):
    full = "{" + ", ".join(f'"{c}": 1' for c in X.BASE_COLUMNS) + "}"
    texts = [full, f"```json\n{full}\n```", f"  ```\n{full}```", full.replace('"AGE": 1, ', ""), full.replace('"AGE": 1', '"AGE": null'),
             "{}", "nothing"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(readers.missing_fields(F.col("t")).alias("m"))
    assert [r["m"] for r in df.collect()] == [[], [], [], ["AGE"], [], X.BASE_COLUMNS, None]


LOG = T.StructType([T.StructField("id", T.LongType()), T.StructField("decided_at", T.TimestampNTZType()),
                    T.StructField("risk_decision", T.StringType()), T.StructField("risk_probability", T.DoubleType())])


def decided(spark, first, last, step=1):
    stamp = F.expr("make_timestamp_ntz(2024, 1, 1, 0, 0, 0) + make_dt_interval(cast(id / 10 as int))")
    return spark.range(first, last, step).select(
        "id", stamp.alias("decided_at"), F.lit("APPROVE").alias("risk_decision"), F.lit(0.5).alias("risk_probability"))


def test_decision_log_appends_and_prunes(spark, tmp_path):
    path = str(tmp_path / "log")
    for first in (0, 30):
        writers.append_decisions(decided(spark, first, first + 30), path)
    log = writers.read_decisions(spark, path, LOG)
    assert log.count() == 60 and log.select("batch_id").distinct().count() == 2
    plan = log.filter("decision_date = DATE'2024-01-05'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(decision_date" in plan


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    for name, first in (("s-0", 0), ("s-1", 25)):
        writers.append_decisions(decided(spark, first, first + 25), path, name)
    before = sorted(writers.read_decisions(spark, path, LOG).collect()), sorted(writers.read_days(spark, path).collect())
    for name, first in (("s-1", 25), ("s-0", 0)):
        writers.append_decisions(decided(spark, first, first + 25).repartition(3), path, name)
    assert (sorted(writers.read_decisions(spark, path, LOG).collect()), sorted(writers.read_days(spark, path).collect())) == before
    writers.append_decisions(decided(spark, 0, 0), path, "s-2")  # a batch without rows
    assert writers.read_decisions(spark, path, LOG).count() == 50


def test_the_newest_entries_are_read_from_their_days_only(spark, tmp_path):
    path = str(tmp_path / "log")
    writers.append_decisions(decided(spark, 0, 100), path)  # ten days of ten
    assert [r["id"] for r in writers.recent_decisions(spark, path, 20, LOG).collect()] == list(range(99, 79, -1))
    assert [d.day for d in writers.newest_days(spark, path, 20)] == [10, 9]
    assert [d.day for d in writers.newest_days(spark, path, 15)] == [10, 9]
    plan = writers.recent_decisions(spark, path, 15, LOG)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "decision_date" in plan.split("PartitionFilters: [")[1]
    # Late entries: a large id on an early day is still found.
    late = spark.createDataFrame([(500, datetime(2024, 1, 2), "REJECT", 0.9)], LOG)
    writers.append_decisions(late, path)
    assert [r["id"] for r in writers.recent_decisions(spark, path, 3, LOG).collect()] == [500, 99, 98]
    assert writers.newest_days(spark, path, 1000) and writers.recent_decisions(spark, path, 1000, LOG).count() == 101


def test_a_busy_day_is_written_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        one_day = spark.range(50_000).select("id", F.expr("make_timestamp_ntz(2024, 1, 1, 0, 0, 0)").alias("decided_at"),
                                             F.md5(F.col("id").cast("string")).alias("risk_decision"), F.rand(1).alias("risk_probability"))
        writers.append_decisions(one_day, path, "b")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list((tmp_path / "log/entries/decision_date=2024-01-01/batch_id=b").glob("part-*"))
    assert len(files) > 1 and writers.read_decisions(spark, path, LOG).count() == 50_000


def test_the_scan_reports_rows_and_bad_rows(spark, tmp_path):
    people = table(spark, applicant(1), applicant(2))
    writers.write_csv(people, str(tmp_path / "csv"))
    (tmp_path / "csv" / "bad.csv").write_text(",".join(people.columns) + "\nx,y\n")
    rows, counted = readers.observed_scan(readers.read_applicants_csv(spark, str(tmp_path / "csv")))
    rows.write.parquet(str(tmp_path / "out"))
    assert counted.get == {"rows": 3, "bad_rows": 1}


def test_texts_are_files_in_a_folder_per_task(spark, tmp_path):
    """As many folders as tasks, not as documents; one file each, whatever is in the text."""
    from creditloom.sources import readers, writers

    texts = [(i, f"text {i}\nline") for i in range(40)] + [(40, ""), (41, None), (42, "a"), (42, "a")]
    writers.write_texts(spark.createDataFrame(texts, "doc_id long, text string").coalesce(2), str(tmp_path / "t"))
    folders = [p for p in (tmp_path / "t").iterdir() if p.is_dir()]
    files = [f for p in folders for f in p.glob("*.txt")]
    assert len(folders) < 20 and len(files) == 43
    got = sorted(r["text"] for r in readers.read_corpus(spark, str(tmp_path / "t") + "/*").collect())
    assert got == sorted([f"text {i}\nline\n" for i in range(40)] + ["\n", "\n", "a\na\n"])


def test_texts_on_a_disk_are_written_by_the_tasks_and_read_as_bytes(spark, tmp_path):
    texts = [(i, f"text {i}") for i in range(30)]
    folder = tmp_path / "t"
    assert writers._on_disk(spark, f"file://{folder}") == writers._on_disk(spark, str(folder)) == str(folder)
    writers.write_texts(spark.createDataFrame(texts, "doc_id long, text string"), f"file://{folder}")
    assert (folder / "_SUCCESS").exists() and not [p for p in folder.rglob(".part-*") if p.suffix != ".crc"]
    with pytest.raises(Exception, match="already exists"):
        writers.write_texts(spark.createDataFrame(texts, "doc_id long, text string"), str(folder))
    one = next(p for p in folder.iterdir() if p.is_dir())
    (one / ".part-000000-77").write_text("of a task that was lost")
    (one / "more.txt.gz").write_bytes(gzip.compress("packed é\n".encode()))
    read = readers.read_corpus(spark, f"{folder}/*")
    assert sorted(r["text"] for r in read.collect()) == sorted([f"text {i}\n" for i in range(30)] + ["packed é\n"])
    assert all(r["path"].startswith("file:///") for r in read.collect())
    assert "binaryFile" in read._jdf.queryExecution().simpleString()
