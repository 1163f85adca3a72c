"""Applicants for the tests: a plain one, with changes."""

from creditloom import fixed as X
from creditloom import schemas as S


def applicant(key=1, target=0, **changes):
    row = {"LIMIT_BAL": 1000.0, "SEX": 1, "EDUCATION": 2, "MARRIAGE": 1, "AGE": 30}
    row.update({c: 0 for c in X.STATUS_COLUMNS})
    row.update({c: 60.0 for c in X.BILL_COLUMNS})
    row.update({c: 30.0 for c in X.PAID_COLUMNS})
    row.update(changes)
    return (key, *[row[c] for c in X.BASE_COLUMNS], target)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), S.APPLICANT)
