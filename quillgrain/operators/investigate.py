"""Investigation of stories and other parent/child records: look-ups, censuses, lineages and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find_by_name(parents: DataFrame, children: DataFrame, asked: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """For each asked text the parents whose name holds it, with number, first and last of their children.

    Parents without children stay; `ambiguous` marks a text that several names hold.
    """
    span = children.groupBy(key).agg(F.count("*").alias("n_children"), F.min(order).alias("first_at"), F.max(order).alias("last_at"))
    hit = parents.join(F.broadcast(asked), F.contains(F.lower(name), F.lower("asked")))
    w = Window.partitionBy("asked")
    return hit.join(span, key, "left").select("asked", key, name, F.coalesce("n_children", F.lit(0)).alias("n_children"), "first_at", "last_at", (F.count("*").over(w) > 1).alias("ambiguous"))


def step_details(turns: DataFrame, steps: DataFrame, variants: DataFrame, turn: str, step: list[str]) -> DataFrame:
    """Steps of turns with their active variant (null: none is active) and the number of all their variants."""
    n = variants.groupBy(*step).agg(F.count("*").alias("n_variants"))
    active = variants.where("active").select(*step, "content")
    return turns.join(steps, turn).join(active, step, "left").join(n, step, "left").withColumn("n_variants", F.coalesce("n_variants", F.lit(0)))


def per_turn(turns: DataFrame, steps: DataFrame, turn: str, order: str, label: str, stale: str) -> DataFrame:
    """Turns with the number of their steps, of stale ones, and the labels in order."""
    s = steps.groupBy(turn).agg(
        F.count("*").alias("n_steps"), F.count_if(F.col(stale)).alias("n_stale"),
        F.expr(f"listagg({label}, ' ') within group (order by {order})").alias("labels"),
    )
    return turns.join(s, turn, "left").fillna(0, ["n_steps", "n_stale"])


def descendants(rows: DataFrame, key: str, ancestors: str) -> DataFrame:
    """Number of rows that have a row among their ancestors, at any depth."""
    up = rows.select(F.explode(ancestors).alias(key)).groupBy(key).agg(F.count("*").alias("n_descendants"))
    return rows.select(key).join(up, key, "left").fillna(0, ["n_descendants"])


def routes(named: dict[str, DataFrame]) -> DataFrame:
    """Distinct rows of several routes to the same things, labelled by the route."""
    frames = [df.distinct().withColumn("route", F.lit(label)) for label, df in named.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def latest(rows: DataFrame, group: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in the given order."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def prefix_budget(rows: DataFrame, group: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows in order until their sizes pass the budget; the first always stays."""
    w = Window.partitionBy(*group).orderBy(*order)
    run = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"spent": run, "rank": F.row_number().over(w)}).where((F.col("spent") <= budget) | (F.col("rank") == 1))


def first_fit_budget(rows: DataFrame, group: str, rank: str, size: str, budget: int) -> DataFrame:
    """Per group the ranks that fit a budget, skipping what doesn't; the first always stays.

    One array a group is folded in rank order; a group is one query's ranked answer and small.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(size).cast("long").alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<int>").alias("kept"))

    def take(s: Column, x: Column) -> Column:
        fits = (F.size(s.kept) == 0) | (s.spent + x.n <= budget)
        return F.struct(F.when(fits, s.spent + x.n).otherwise(s.spent).alias("spent"), F.when(fits, F.concat(s.kept, F.array(x.r.cast("int")))).otherwise(s.kept).alias("kept"))

    return rows.groupBy(group).agg(F.aggregate(items, start, take).alias("f")).select(group, F.col("f.spent").alias("spent"), F.explode("f.kept").alias(rank))


def streaks(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """For each row how many equal values in a row end here; a null or blank value has none."""
    w = Window.partitionBy(group).orderBy(*order)
    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    turn = F.coalesce((F.lag(value).over(w) != F.col(value)) | blank, F.lit(True)).cast("int")
    island = Window.partitionBy(group, "_i").orderBy(*order)
    out = rows.withColumn("_t", turn).withColumn("_i", F.sum("_t").over(w))
    return out.withColumn("held_for", F.when(blank, 0).otherwise(F.row_number().over(island))).drop("_t", "_i")


def stalls(rows: DataFrame, group: str, order: list[str], step: str, progress: str, limit: int = 2) -> DataFrame:
    """Consecutive rows without progress that repeat the step before; `stalled` from the limit on."""
    w = Window.partitionBy(group).orderBy(*order)
    stuck = F.coalesce(~F.col(progress) & (F.lag(step).over(w) == F.col(step)), F.lit(False))
    out = rows.withColumn("_s", stuck).withColumn("_i", F.sum((~F.col("_s")).cast("int")).over(w))
    n = F.sum(F.col("_s").cast("int")).over(Window.partitionBy(group, "_i").orderBy(*order))
    return out.withColumn("stalls", n).withColumn("stalled", F.col("stalls") >= limit).drop("_s", "_i")
