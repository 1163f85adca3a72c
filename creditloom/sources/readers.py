"""Readers. Schemas are declared; bad rows are kept beside the good ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed as X
from .. import schemas as S
from ..functions.text import strip

COMPRESSED = ("bz2", "deflate", "gz", "lz4", "snappy", "zst")  # files that Hadoop unpacks, by their ending


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """`.parquet` as parquet, anything else as CSV with a header."""
    if path.rstrip("/").endswith(".parquet"):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    if schema is None:
        raise ValueError("a CSV source needs a schema")
    return spark.read.schema(schema).option("header", True).csv(path)


def read_applicants_csv(spark: SparkSession, path: str) -> DataFrame:
    """Applicants from CSV. A malformed line keeps its text in `_corrupt_record`."""
    schema = T.StructType([*S.APPLICANT.fields, S.CORRUPT_FIELD])
    return (
        spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", S.CORRUPT).csv(path)
    )


def observed_scan(df: DataFrame, corrupt: str = S.CORRUPT) -> tuple[DataFrame, Observation]:
    """The scan, and what the first job on it will tell: `rows` and `bad_rows`. No scan of its own."""
    counted = Observation("scan")
    bad = F.count_if(F.col(corrupt).isNotNull()) if corrupt in df.columns else F.lit(0).cast("long")
    return df.observe(counted, F.count(F.lit(1)).alias("rows"), bad.alias("bad_rows")), counted


def coded_names() -> dict[str, str]:
    """X1..X23 in the public data set, in base column order."""
    return {f"X{at}": name for at, name in enumerate(X.BASE_COLUMNS, 1)}


def rename_coded(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(coded_names())


def attach_label(features: DataFrame, labels: DataFrame, key: str = X.KEY) -> DataFrame:
    """Label beside the features, by key: rows have no position in Spark."""
    return features.join(labels.select(key, X.TARGET), key)


def cut_front_matter(text: Column) -> Column:
    """What follows the first end-of-front-matter marker, or the whole text."""
    at = F.instr(text, X.FRONT_MATTER_END)
    rest = F.substring(text, at + F.lit(len(X.FRONT_MATTER_END)), F.length(text))
    return F.when(at > 0, rest).otherwise(text)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: (path, doc_id, text) without the front matter.

    Files are read as bytes: Spark's reader of whole texts looks up all codecs again for each file, which costs more than
    the file. It reads the compressed ones.
    """
    plain = spark.read.format("binaryFile").load(path).select(F.input_file_name().alias("path"), F.col("content").cast("string").alias("text"))
    packed = spark.read.option("pathGlobFilter", f"*.{{{','.join(COMPRESSED)}}}").text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text"))
    files = plain.filter(~F.col("path").rlike(rf"\.({'|'.join(COMPRESSED)})$")).unionByName(packed)
    return files.select("path", F.xxhash64("path").alias("doc_id"), cut_front_matter(F.col("text")).alias("text"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Fails when the store is missing."""
    return spark.read.schema(S.CHUNK).parquet(path)


def parse_requests(df: DataFrame, column: str) -> DataFrame:
    """JSON text to the 23 typed fields; `valid` needs all of them."""
    schema = T.StructType([*S.REQUEST.fields, S.CORRUPT_FIELD])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT}
    parsed = df.withColumn("request", F.from_json(F.col(column), schema, options))
    complete = F.col(f"request.{S.CORRUPT}").isNull()
    for name in X.BASE_COLUMNS:
        complete = complete & F.col(f"request.{name}").isNotNull()
    return parsed.withColumn("valid", F.coalesce(complete, F.lit(False)))


def unfence(text: Column) -> Column:
    """Cut Markdown code fences around a JSON record."""
    return strip(F.regexp_replace(strip(text), X.FENCE_PATTERN, ""))


def missing_fields(text: Column) -> Column:
    """Required keys a JSON record lacks, in base column order; null if not an object."""
    required = F.array(*[F.lit(c) for c in X.BASE_COLUMNS])
    return F.array_except(required, F.json_object_keys(unfence(text)))
