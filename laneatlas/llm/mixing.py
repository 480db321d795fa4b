"""Mixing of sources to target weights by capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import meet, with_row_key, written

#: Cells of the seeded order in which each source is cut; its documents beyond the cell of the cut are never sorted.
CELLS = 4096


def water_fill(sizes: list[float], weights: list[float], budget: float, max_epochs: float) -> list[float]:
    """Targets proportional to weights, at most max_epochs * size each; what is cut off is shared out again by weight
    among the others until none is above its cap. Sources with no size or weight get 0. If all reach their caps, the
    rest of the budget stays unspent."""
    caps = [max_epochs * s for s in sizes]
    target = [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if caps[i] > 0 and weights[i] > 0]
    left = float(budget)
    while free and left > 0:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total >= caps[i]]
        if not full:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = caps[i]
        left -= sum(caps[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return target


def _targets(totals: DataFrame, share: float, cycle: tuple[float, ...], max_epochs: float, weights: dict | None) -> DataFrame:
    """totals (source, source_size, rows) with target: water_fill() as windows over one row a source.

    In the order of cap over weight, a source is full if what is left after the caps before it, shared by weight among it and those behind, reaches its
    cap; then all before it are full as well, and the others share the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    if weights is None:
        weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.row_number().over(by_name) - 1) % len(cycle) + 1)
    else:
        named = {k: float(v) for k, v in weights.items() if k is not None}
        weight = F.try_element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col("source")) if named else F.lit(None).cast("double")
        weight = F.coalesce(F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0)))).otherwise(weight), F.lit(0.0))
    all_, total = Window.partitionBy(), F.sum("source_size").over(Window.partitionBy())
    t = totals.withColumn("_w", weight).withColumn("_budget", share * total).withColumn("_cap", max_epochs * F.col("source_size"))
    t = t.withColumn("_on", (F.col("_cap") > 0) & (F.col("_w") > 0)).withColumn("_w", F.when(F.col("_on"), F.col("_w")).otherwise(0.0)).withColumn("_cap", F.when(F.col("_on"), F.col("_cap")).otherwise(0.0))
    before = Window.orderBy(F.when(F.col("_on"), F.col("_cap") / F.col("_w")), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    t = t.withColumn("_left", F.col("_budget") - gone("_cap")).withColumn("_behind", F.sum("_w").over(all_) - gone("_w"))
    t = t.withColumn("_full", F.col("_on") & (F.col("_left") * F.col("_w") >= F.col("_cap") * F.col("_behind") * (1 - 1e-12)))
    t = t.withColumn("_left", F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(all_))
    t = t.withColumn("_free", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(all_))
    target = F.when(F.col("_full"), F.col("_cap")).when(F.col("_on") & (F.col("_left") > 0), F.col("_left") * F.col("_w") / F.col("_free")).otherwise(0.0)
    return t.select("source", "source_size", "rows", target.alias("target"))


def mix(docs: DataFrame, share: float = 1.5, cycle: tuple[float, ...] = (3, 1, 2), max_epochs: float = 2, seed: int = 17, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: dict | None = None, row: str | None = None) -> DataFrame:
    """For every row: doc_id, source, size (words), source_size, target, whole (full repetitions), extra (0 or 1 more), taken, row.

    Sources in code point order, null last, take the weights of `cycle` in turn, or those of `weights` by name. A source's whole
    repetitions are floor(target / size); the rest goes to its documents in a seeded order until the target is met to within half a
    document. Null texts have size 0; a null source is a source; repeated rows count each; further columns are ignored, whatever their names.
    An empty table gives an empty result. Any number of sources: their totals, one row each, are weighed by windows.
    A source of any share of the rows is summed in CELLS partial cells; only the cell in which its cut falls is sorted.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    keys = ["no_source", "name"]
    rows = rows.withColumn("no_source", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    rows = written(rows.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "source", "size")).withColumn("cell", F.shiftrightunsigned("u", 52).cast("int")))
    cells = written(rows.groupBy(*keys, "cell").agg(F.sum("size").alias("cell_size"), F.count("*").alias("rows")))
    totals = cells.groupBy(*keys).agg(F.sum("cell_size").alias("source_size"), F.sum("rows").alias("rows"))
    named = totals.select(F.when(~F.col("no_source"), F.col("name")).alias("source"), "source_size", "rows")
    plan = _targets(named, share, cycle, max_epochs, weights).withColumn("no_source", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit(""))).drop("source")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = written(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    sums = cells.withColumn("upto", F.sum("cell_size").over(Window.partitionBy(*keys).orderBy("cell")))
    cut = sums.join(plan.select(*keys, "rest"), keys).where(F.col("upto") > F.col("rest")).groupBy(*keys).agg(F.min(F.struct("cell", (F.col("upto") - F.col("cell_size")).alias("below"))).alias("cut"))
    plan = plan.join(cut, keys, "left").select(*keys, "source_size", "rows", "target", "whole", "rest", F.col("cut.cell").alias("cut_cell"), "cut.below")
    full = meet(rows, written(plan), keys, "rows", rows.count())
    settled = full.where(F.col("cut_cell").isNull() | (F.col("cell") != F.col("cut_cell")))
    settled = settled.withColumn("extra", ((F.col("rest") > 0) & (F.col("cut_cell").isNull() | (F.col("cell") < F.col("cut_cell")))).cast("long"))
    within = Window.partitionBy(*keys).orderBy("u", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = full.where(F.col("cell") == F.col("cut_cell")).withColumn("mid", F.sum("size").over(within) - F.col("size") / 2)
    open_ = open_.withColumn("extra", ((F.col("rest") > 0) & (F.col("below") + F.col("mid") <= F.col("rest"))).cast("long")).drop("mid")
    out = settled.unionByName(open_)
    return out.select("doc_id", "source", "size", "source_size", "target", "whole", "extra", (F.col("size") * (F.col("whole") + F.col("extra"))).alias("taken"), "row")


def repeat_to_mix(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, all columns of docs, whatever their names."""
    numbered, row = with_row_key(docs, doc_id)
    free = lambda name: name if name not in numbered.columns else free(name + "_")
    times, copy = free("_times"), free("_copy")
    taken = mix(numbered, doc_id=doc_id, row=row, **how).select(F.col("row").alias(row), (F.col("whole") + F.col("extra")).cast("int").alias(times)).where(F.col(times) > 0)
    return numbered.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)
