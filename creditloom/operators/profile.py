"""Data profile. Every report is one aggregate over one scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import combinations
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions.numbers import EXACT, percent
from ..session import materialize

BINS = 2048  # a bracket is cut into
FEW = 4096  # rows of a bracket that are looked at one by one


def _rows(structs: Sequence[Column]) -> Column:
    return F.inline(F.array(*structs))


# Reports over many columns are written as SQL expressions: a few hundred of them
# are one call, not a few thousand.

def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _inline(structs: Sequence[str]) -> str:
    return f"inline(array({', '.join(structs)}))"


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def preview(df: DataFrame, key: str = X.KEY, n: int = 5) -> DataFrame:
    """First rows in key order, so that the answer is stable."""
    return df.orderBy(key).limit(n)


def schema_listing(df: DataFrame) -> DataFrame:
    rows = list(enumerate(df.dtypes))
    return df.sparkSession.createDataFrame(
        [(at, name, kind) for at, (name, kind) in rows], "position int, column_name string, data_type string"
    )


def class_distribution(df: DataFrame, label: str = X.TARGET) -> DataFrame:
    # The window runs over the classes, not over the rows.
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select(
        label, "n", percent(F.col("n"), total).alias("pct"), F.round(F.col("n") / total, 3).alias("share")
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Columns with nulls, most affected first; one scan for all columns."""
    total = F.count(F.lit(1)).alias("total")
    counts = df.agg(total, *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count"),
                     percent(F.col(c), F.col("total")).alias("null_pct")) for c in df.columns]
    return (
        counts.select(_rows(rows)).filter("null_count > 0")
        .orderBy(F.desc("null_pct"), "column_name")
    )


def describe(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """count, mean, standard deviation, min and max for all columns in one pass."""
    one_row = df.selectExpr(*[
        f"""struct(
            count({c}) AS n,
            round(CAST(sum(CAST({c} AS {EXACT})) AS DOUBLE) / nullif(count({c}), 0), {digits}) AS mean,
            round(stddev_samp({c}), {digits}) AS stddev,
            CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max) AS {c}"""
        for c in map(_name, columns)
    ])
    return one_row.selectExpr(_inline([
        f"struct({_text(c)} AS column_name, {_name(c)}.n, {_name(c)}.mean, {_name(c)}.stddev, {_name(c)}.min, {_name(c)}.max)"
        for c in columns
    ]))


def class_histogram(df: DataFrame, value: str = "LIMIT_BAL", label: str = X.TARGET, bins: int = 50) -> DataFrame:
    """Equal bins per class over that class's own range; the last bin is closed.

    Empty bins are kept. The range table has one row per class and is written
    first, so its size is known: a small one is broadcast, since a shuffle by
    class would send everything to two tasks.
    """
    low, high = F.min(value), F.max(value)
    spread = low == high
    ranges = df.groupBy(label).agg(
        F.when(spread, low - 0.5).otherwise(low).alias("low"),
        F.when(spread, high + 0.5).otherwise(high).alias("high"),
    ).withColumn("width", (F.col("high") - F.col("low")) / bins)
    ranges = materialize(ranges, "ranges")
    placed = df.select(label, value).join(ranges, label).select(
        label, F.least(F.floor((F.col(value) - F.col("low")) / F.col("width")), F.lit(bins - 1)).alias("bin")
    )
    counted = placed.groupBy(label, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = ranges.select(label, "low", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return every.join(counted, [label, "bin"], "left").select(
        label, "bin",
        F.round(F.col("low") + F.col("bin") * F.col("width"), 2).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def default_rate(df: DataFrame, by: str, label: str = X.TARGET) -> DataFrame:
    total, bad = F.count(F.lit(1)), F.sum(F.col(label).cast("long"))
    return df.groupBy(by).agg(total.alias("total"), percent(bad, F.count(label)).alias("default_rate_pct"))


def correlation(df: DataFrame, columns: Sequence[str] = X.CORRELATION_COLUMNS, digits: int = 6) -> DataFrame:
    """Pearson matrix of the columns that exist, pairwise complete, in one aggregate."""
    present = [c for c in columns if c in df.columns]
    pairs = list(combinations(range(len(present)), 2))
    one_row = df.selectExpr(*[
        f"round(corr(CAST({_name(present[i])} AS DOUBLE), CAST({_name(present[j])} AS DOUBLE)), {digits}) AS r{i}_{j}"
        for i, j in pairs
    ])

    def cell(i: int, j: int, value: str) -> str:
        return f"struct({_text(present[i])} AS col_a, {_text(present[j])} AS col_b, {value} AS corr)"

    cells = [cell(i, i, "1.0D") for i in range(len(present))]
    for i, j in pairs:
        cells += [cell(i, j, f"r{i}_{j}"), cell(j, i, f"r{i}_{j}")]
    return one_row.selectExpr(_inline(cells))


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column_name, share, value): exact quantiles with linear interpolation, null for a column without a value.

    Every wanted rank has a bracket of values that holds it. A round counts the
    values of all brackets of all columns in BINS bins each, in one scan; the bin
    that holds the rank is the next bracket. Bins are equal in the order of
    double-precision numbers, so BINS to the sixth power is all there is, and a
    bracket also shrinks to the values that are there. Once a bracket holds few
    rows, they are looked at. What comes to the driver is the counts of the
    brackets and, at the end, at most FEW different values of each.
    """
    names = list(columns)
    numbers = df.select(*[F.col(_name(c)).cast("double").alias(f"c{at}") for at, c in enumerate(names)])
    ranges = numbers.agg(*[f(F.when(~F.isnan(f"c{at}"), F.col(f"c{at}"))).alias(f"{kind}{at}")
                           for at in range(len(names)) for kind, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
    wanted: dict[tuple[int, int], float | None] = {}  # (column, rank) -> value
    open_ranks = []
    for at in range(len(names)):
        n = ranges[f"n{at}"]
        for rank in {r for share in shares if n for r in (floor(share * (n - 1)), ceil(share * (n - 1)))}:
            wanted[at, rank] = None
            open_ranks.append(Bracket(at, rank, 0, n, ranges[f"low{at}"], ranges[f"high{at}"]))
    while open_ranks:
        done = [b for b in open_ranks if b.low == b.high]
        wanted.update({(b.column, b.rank): b.low for b in done})
        few = [b for b in open_ranks if b.low < b.high and b.rows <= FEW]
        if few:
            wanted.update(_looked_up(numbers, few))
        open_ranks = _narrowed(numbers, [b for b in open_ranks if b.low < b.high and b.rows > FEW])
    rows = []
    for at, name in enumerate(names):
        n = ranges[f"n{at}"]
        for share in shares:
            place = share * (n - 1)
            low, high = (wanted.get((at, f(place))) if n else None for f in (floor, ceil))
            between = low if low == high else low + (high - low) * (place - floor(place))
            rows.append((name, float(share), between))
    return df.sparkSession.createDataFrame(rows, "column_name string, share double, value double")


@dataclass(frozen=True)
class Bracket:
    """A rank of a column lies among `rows` values from `low` to `high`, `below` others being smaller."""

    column: int
    rank: int
    below: int
    rows: int
    low: float
    high: float

    @property
    def span(self) -> tuple[int, float, float]:
        return self.column, self.low, self.high


def _order(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros are one."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)


def _steps(low: float, high: float) -> np.ndarray:
    """Where the bins of a bracket begin."""
    first, last = (int(x) for x in _order(np.array([low, high])))
    return np.array([first + (last - first + 1) * at // BINS for at in range(BINS)], np.int64)


def _narrowed(numbers: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    """The bin that holds the rank of each bracket; one scan for all of them."""
    if not brackets:
        return []
    spans = sorted({b.span for b in brackets})
    steps = [_steps(low, high) for _, low, high in spans]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((len(spans), BINS), np.int64)
        least, most = np.full((len(spans), BINS), np.inf), np.full((len(spans), BINS), -np.inf)
        for batch in batches:
            for at, (column, low, high) in enumerate(spans):
                values = batch.column(column).drop_null().to_numpy(zero_copy_only=False)
                values = values[(values >= low) & (values <= high)]
                bins = np.searchsorted(steps[at], _order(values), side="right") - 1
                rows[at] += np.bincount(bins, minlength=BINS)
                np.minimum.at(least[at], bins, values)
                np.maximum.at(most[at], bins, values)
        used = np.nonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (*(u.astype(np.int32) for u in used), rows[used], least[used], most[used])], ["span", "bin", "n", "low", "high"])

    counted = numbers.mapInArrow(count, "span int, bin int, n long, low double, high double").groupBy("span", "bin").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    bins: dict[tuple, list] = {}
    for row in counted.orderBy("span", "bin").toLocalIterator():
        bins.setdefault(spans[row["span"]], []).append(row)
    out = []
    for b in brackets:
        below = b.below
        for row in bins[b.span]:
            if b.rank < below + row["n"]:
                out.append(replace(b, below=below, rows=row["n"], low=row["low"], high=row["high"]))
                break
            below += row["n"]
    return out


def _looked_up(numbers: DataFrame, brackets: list[Bracket]) -> dict[tuple[int, int], float]:
    """The values of ranks whose brackets hold FEW rows or fewer."""
    spans = sorted({b.span for b in brackets})
    held = F.array_compact(F.array(*[
        F.when(F.col(f"c{column}").between(low, high), F.struct(F.lit(at).alias("span"), F.col(f"c{column}").alias("value")))
        for at, (column, low, high) in enumerate(spans)]))
    counted = numbers.select(F.inline(held)).groupBy("span", "value").agg(F.count(F.lit(1)).alias("n"))
    values: dict[tuple, list] = {}
    for row in counted.orderBy("span", "value").toLocalIterator():
        values.setdefault(spans[row["span"]], []).append(row)
    out = {}
    for b in brackets:
        below = b.below
        for row in values[b.span]:
            below += row["n"]
            if b.rank < below:
                out[b.column, b.rank] = row["value"]
                break
    return out


def dataset_summary(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Describe with quartiles, one row per column."""
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    quartiles = quantiles(df, columns, tuple(names)).groupBy("column_name").agg(*[
        F.round(F.max(F.when(F.col("share") == share, F.col("value"))), digits).alias(name)
        for share, name in names.items()
    ])
    return describe(df, columns, digits).join(quartiles, "column_name", "left")


def sample_rows(df: DataFrame, columns: Sequence[str], key: str = X.KEY, n: int = 5) -> DataFrame:
    """The first rows in key order that go with a summary: (row, column_name, value as text)."""
    numbered = preview(df, key, n).select(F.row_number().over(Window.orderBy(key)).alias("row"), *columns)  # n rows
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(_name(c)).cast("string").alias("value")) for c in columns])
    return numbered.select("row", F.inline(cells))
