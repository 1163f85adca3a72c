"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree, by default domain, language, source. A token budget is
poured from the root: each node shares its budget among its children by weight,
and a child that can't use its share (its texts times the most epochs) leaves the
rest to its siblings. A child's capacity is that of everything below it, so
shortages are met among siblings first and reach an ancestor only when a whole
branch is short. A leaf takes whole epochs and then, in the seeded order of the
next epoch, the documents up to its remaining tokens.

Only DataFrame functions. What meets in one window is the children of a node or
one of 4096 buckets of a leaf's order, found in two steps, never a leaf's rows:
a leaf may hold a third of all documents. Texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .simhash import unused

EPOCHS = 4
SEED = 42
BUCKET_DIGITS = 3  # hex digits of the order key a step looks at
WORD = r"[^\x20\x09-\x0D]+"
BIG = "decimal(20,0)"  # tokens of a node; weights are longs


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _lookup(weights: Mapping[str, int], path: Column) -> Column:
    """Weight of a node by its path, names joined by `/`; 1 where nothing is said."""
    for name, weight in weights.items():
        if weight < 0 or weight != int(weight):
            raise ValueError(f"weights are whole numbers from 0: {name}")
    if not weights:
        return F.lit(1).cast("long")
    listed = F.create_map(*[F.lit(x) for name, weight in weights.items() for x in (name, int(weight))])
    return F.coalesce(F.element_at(listed, path), F.lit(1)).cast("long")


def pour(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Adds `granted`: the share of `budget` (equal within a parent) by `weight`, at most `capacity`.

    Children in order of capacity per weight are filled as long as an equal share
    covers them; the rest share what is left, cut to whole tokens so that nothing
    is lost. A child of weight 0 gets nothing.
    """
    group = [F.col(c) for c in parent]
    order = [F.when(F.col("weight") == 0, 1).otherwise(0), F.try_divide(F.col("capacity").cast("double"), F.col("weight").cast("double")),
             F.col(name).asc_nulls_first()]
    window = Window.partitionBy(*group).orderBy(*order)
    before, on = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    so_far, everyone = window.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*group)

    def whole(column: Column) -> Column:
        return column.cast(BIG)

    left = whole(F.col("budget")) - F.coalesce(whole(F.sum("capacity").over(before)), F.lit(0).cast(BIG))
    told = nodes.withColumns({"_left": whole(left), "_weights": F.sum("weight").over(on)})
    fits = (F.col("weight") > 0) & (whole(F.col("capacity")) * F.col("_weights") <= F.col("_left") * F.col("weight"))
    told = told.withColumn("_fits", fits).withColumn("_full", F.min("_fits").over(so_far))
    open_weight = F.when(F.col("_full"), 0).otherwise(F.col("weight"))
    told = told.withColumns({
        "_rest": F.greatest(F.lit(0).cast(BIG), whole(F.col("budget")) - F.coalesce(
            whole(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(everyone)), F.lit(0).cast(BIG))),
        "_sum": F.sum(open_weight).over(everyone), "_upto": F.sum(open_weight).over(so_far), "_own": open_weight})
    share = F.expr("_rest * _upto div _sum") - F.expr("_rest * (_upto - _own) div _sum")
    granted = F.when(F.col("_full"), F.col("capacity")).when(F.col("_sum") > 0, share).otherwise(F.lit(0)).cast("long")
    return told.withColumn("granted", granted).drop("_left", "_weights", "_fits", "_full", "_rest", "_sum", "_upto", "_own")


def leaf_budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, int], budget: int | None = None, epochs: int = EPOCHS,
) -> DataFrame:
    """(*levels, supply, granted, full_epochs, rest) from (*levels, supply), one row per leaf.

    `budget` is in tokens; by default all there are, once.
    """
    levels = list(levels)
    total = F.lit(budget).cast("long") if budget is not None else F.sum("supply").over(Window.partitionBy(F.lit(1)))
    found = leaves.withColumns({"capacity": F.col("supply") * epochs, "budget": total})
    names = [F.coalesce(F.col(c), F.lit("")) for c in levels]
    for depth, level in enumerate(levels):
        parent, path = levels[:depth], levels[:depth + 1]
        node = found.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.max("budget").alias("budget"))
        node = node.withColumn("weight", _lookup(weights, F.concat_ws("/", *names[:depth + 1])))
        granted = pour(node, parent, level).select(*[F.col(c).alias(f"_{c}") for c in path], "granted")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in path]
        matches = same[0]
        for condition in same[1:]:
            matches = matches & condition
        found = found.join(granted, matches).withColumn("budget", F.col("granted")).drop("granted", *[f"_{c}" for c in path])
    full = F.when(F.col("supply") > 0, F.expr("budget div supply")).otherwise(F.lit(0))
    return found.select(*levels, "supply", F.col("budget").alias("granted"), full.cast("long").alias("full_epochs")).withColumn(
        "rest", F.col("granted") - F.col("full_epochs") * F.col("supply"))


def order_key(key: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in the order of an epoch: 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("null"))))


def _last_keys(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """(leaf, last): the order key of the last document of the epoch that is not taken whole.

    Documents are taken while the tokens before them are fewer than the rest.
    Two steps narrow a leaf to one bucket of its order; only that one is ranked.
    """
    open_leaves = leaves.filter(F.col("rest") > 0)
    cut = open_leaves.select("leaf", "full_epochs", F.col("rest").alias("_rest"), F.lit("").alias("prefix"))
    in_order = Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    order = order_key(F.col("key"), F.col("full_epochs"), seed)

    def narrowed(digits: int) -> DataFrame:
        """The first places of each leaf, in order, with the tokens before them."""
        # One join, then sums by place: rows of a frequent leaf can be split between tasks.
        inside = rows.join(cut, "leaf").withColumn("order", order).filter(F.col("order").startswith(F.col("prefix")))
        summed = inside.groupBy("leaf", F.substring("order", 1, digits).alias("place")).agg(
            F.sum("n_tokens").alias("tokens"), F.max("_rest").alias("_rest"), F.max("full_epochs").alias("full_epochs"))
        told = summed.withColumn("_before", F.coalesce(F.sum("tokens").over(in_order), F.lit(0)))
        return told.filter(F.col("_before") < F.col("_rest"))

    for step in (1, 2):
        last = narrowed(step * BUCKET_DIGITS).groupBy("leaf", "full_epochs").agg(
            F.max(F.struct("place", (F.col("_rest") - F.col("_before")).alias("left"))).alias("last"))
        cut = materialize(last.select(
            "leaf", "full_epochs", F.col("last.left").cast("long").alias("_rest"), F.col("last.place").alias("prefix")), "cut")
    return narrowed(32).groupBy("leaf").agg(F.max("place").alias("last"))


def plan(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, int], *, budget: int | None = None,
    epochs: int = EPOCHS, seed: int = SEED, key: str = "doc_id", tokens: Column | None = None,
) -> DataFrame:
    """(leaf, *levels, supply, granted, full_epochs, rest, last), one row per leaf of the tree that has documents."""
    names = list(levels)
    size = word_count(F.col("text")) if tokens is None else tokens
    parts = [column.cast("string").alias(name) for name, column in levels.items()]
    rows = docs.select(F.col(key).alias("key"), size.cast("long").alias("n_tokens"), *parts)
    rows = materialize(rows.withColumn("leaf", _leaf([F.col(n) for n in names])).select("key", "leaf", "n_tokens", *names), "mix-rows")
    leaves = rows.groupBy("leaf", *names).agg(F.sum("n_tokens").alias("supply"))
    budgets = leaf_budgets(leaves.drop("leaf"), names, weights, budget, epochs)
    budgets = materialize(budgets.withColumn("leaf", _leaf([F.col(n) for n in names])), "budgets")
    # Written, so that its size is known before texts are joined: a small tree is broadcast.
    return materialize(budgets.join(_last_keys(rows, budgets, seed), "leaf", "left"), "mix-plan")


def _leaf(parts: list[Column]) -> Column:
    """One name for a leaf; a null level differs from any text."""
    return F.to_json(F.array(*parts))


def _copies(key: Column, seed: int) -> Column:
    taken = F.coalesce(order_key(key, F.col("_full_epochs"), seed) <= F.col("_last"), F.lit(False))
    return F.col("_full_epochs") + F.when(taken, 1).otherwise(0)


def mixed(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, int], *, budget: int | None = None,
    epochs: int = EPOCHS, seed: int = SEED, key: str = "doc_id", tokens: Column | None = None,
) -> DataFrame:
    """(key, *levels, n_tokens, granted, copies), one row per row of `docs`: how often the mixture has it.

    `levels` name the tree's levels from the top and say how to read them off a
    row; `weights` are whole numbers by path (`web`, `web/en`, ...), 1 where none
    is given. A null level is a node of its own, with the weight of an empty
    name. `tokens` defaults to the words of column `text`; a null text has none.
    Rows with equal keys have the same place in every order and are taken
    together; null keys count as one. The tokens of a leaf exceed its grant by
    one such document at most. An empty table gives an empty result.
    """
    names = list(levels)
    size = word_count(F.col("text")) if tokens is None else tokens
    found = plan(docs, levels, weights, budget=budget, epochs=epochs, seed=seed, key=key, tokens=tokens).select(
        F.col("leaf"), "granted", F.col("full_epochs").alias("_full_epochs"), F.col("last").alias("_last"))
    rows = docs.select(
        F.col(key).alias("key"), *[c.cast("string").alias(n) for n, c in levels.items()], size.cast("long").alias("n_tokens"))
    told = rows.withColumn("leaf", _leaf([F.col(n) for n in names])).join(found, "leaf")
    return told.select(F.col("key").alias(key), *names, "n_tokens", "granted", _copies(F.col("key"), seed).alias("copies"))


def take_mixture(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, int], *, budget: int | None = None,
    epochs: int = EPOCHS, seed: int = SEED, key: str = "doc_id", tokens: Column | None = None,
) -> DataFrame:
    """The rows of `docs`, each as often as the mixture has it; columns as they were."""
    found = plan(docs, levels, weights, budget=budget, epochs=epochs, seed=seed, key=key, tokens=tokens)
    spare = {name: unused(docs, name) for name in ("leaf", "copy")}
    told = found.select(F.col("leaf").alias(spare["leaf"]), F.struct(
        F.col("full_epochs").alias("_full_epochs"), F.col("last").alias("_last")).alias(spare["copy"]))
    marked = docs.withColumn(spare["leaf"], _leaf([c.cast("string") for c in levels.values()])).join(told, spare["leaf"])
    plan_ = F.col(spare["copy"])
    taken = F.coalesce(order_key(F.col(key), plan_["_full_epochs"], seed) <= plan_["_last"], F.lit(False))
    copies = plan_["_full_epochs"] + F.when(taken, 1).otherwise(0)
    return marked.withColumn(spare["copy"], F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*docs.columns)
