"""Declared schemas; nothing is inferred from the data."""

from pyspark.sql import types as T

from . import fixed as X

_DOUBLE = {"LIMIT_BAL", *X.BILL_COLUMNS, *X.PAID_COLUMNS}

BASE_FIELDS = [
    T.StructField(c, T.DoubleType() if c in _DOUBLE else T.IntegerType()) for c in X.BASE_COLUMNS
]
KEY_FIELD = T.StructField(X.KEY, T.LongType())
TARGET_FIELD = T.StructField(X.TARGET, T.IntegerType())
CORRUPT = "_corrupt_record"
CORRUPT_FIELD = T.StructField(CORRUPT, T.StringType())

REQUEST = T.StructType(BASE_FIELDS)
APPLICANT = T.StructType([KEY_FIELD, *BASE_FIELDS, TARGET_FIELD])

CHUNK = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("id", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
])
CHUNK_KEY = ["doc_id", "ord", "part"]

FACTOR = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("impact", T.DoubleType()),
    T.StructField("value", T.DoubleType()),
])
FACTORS = T.ArrayType(FACTOR)

METRICS = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("accuracy", "precision", "recall", "f1_score", "roc_auc", "naive_baseline")]
)
STORE = T.StructType([*CHUNK.fields, T.StructField("counts", T.ArrayType(T.IntegerType()))])

DECISION = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("decided_at", T.TimestampNTZType()), KEY_FIELD,
    T.StructField("applicant_data", T.StructType([
        *BASE_FIELDS, *[T.StructField(c, T.IntegerType() if c in X.WHOLE_FEATURES else T.DoubleType()) for c in X.ENGINEERED_COLUMNS]])),
    T.StructField("risk_probability", T.DoubleType()), T.StructField("risk_decision", T.StringType()),
    T.StructField("top_risk_factors", FACTORS), T.StructField("compliance_question", T.StringType()),
    T.StructField("compliance_answer", T.StringType()), T.StructField("compliance_sources", T.ArrayType(T.StringType())),
])
LOG_FOLDERS = [T.StructField("decision_date", T.DateType()), T.StructField("batch_id", T.StringType())]
LOG_DAYS = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), *LOG_FOLDERS])
