"""Spatial joins: which rectangles overlap, on a grid of levels.

A rectangle belongs to the level whose cells are as wide as its longer side or up to twice that, so it touches four cells of that level at
most, and of any coarser one. Two rectangles meet on the coarser of their levels: each side is repeated on the levels
that the other side has, from its own on, and a pair that shares several cells is kept by the one that owns it, where the lower corner of what they have in common lies.
So large and small rectangles join without a guess at a cell's width, and cells that many rectangles share are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.dealing import met

SIDES = ("x0", "y0", "x1", "y1")


def level(box: Column) -> Column:
    """The power of two that is a cell's width for a box: not less than its longer side, nor so small that cells' numbers leave their range."""
    side = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"])
    far = F.greatest(*(F.abs(box[k]) for k in SIDES), F.lit(1e-200))
    return F.greatest(F.when(side > 0, F.ceil(F.log2(side))).otherwise(-1000), F.ceil(F.log2(far)) - 40).cast("int")


def _cells(df: DataFrame, box: str, levels: DataFrame) -> DataFrame:
    """df once for each cell that its box touches on each of the levels (some dozens of rows) that are not below its own."""
    coarser = df.join(F.broadcast(levels), levels["__level"] >= level(F.col(box)))
    at = lambda k: F.floor(F.col(box)[k] / F.pow(F.lit(2.0), F.col("__level"))).cast("long")
    span = lambda a, b, n: F.explode(F.sequence(at(a), at(b))).alias(n)
    return coarser.select("*", span("x0", "x1", "__x")).select("*", span("y0", "y1", "__y"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_box: str, right_box: str, rows: int | None = None) -> DataFrame:
    """left's and right's columns (no names in common but keys) for each pair of equal keys whose boxes, structs of x0, y0, x1, y1, share a point, edges included.

    Rows with null keys or sides, sides that are no finite numbers, or an end before its start, are in no pair."""
    finite = lambda box: " AND ".join(f"abs({box}.{k}) < 1e300" for k in SIDES)
    whole = lambda df, box: df.where(F.expr(f"{box}.x0 <= {box}.x1 AND {box}.y0 <= {box}.y1 AND {finite(box)}")).dropna(subset=keys)
    left, right = whole(left, left_box), whole(right, right_box)
    levels = lambda df, box: df.select(level(F.col(box)).alias("__level")).distinct()
    # two boxes meet on the coarser of their levels, which one of them has as its own
    shared = levels(left, left_box).union(levels(right, right_box)).distinct()
    a = _cells(left, left_box, shared).withColumn("__own", level(F.col(left_box)))
    b = _cells(right, right_box, shared).withColumn("__other", level(F.col(right_box)))
    pairs = met(a, b, [*keys, "__level", "__x", "__y"], rows).where(F.col("__level") == F.greatest("__own", "__other"))
    l, r = F.col(left_box), F.col(right_box)
    pairs = pairs.where((l["x0"] <= r["x1"]) & (r["x0"] <= l["x1"]) & (l["y0"] <= r["y1"]) & (r["y0"] <= l["y1"]))
    corner = lambda k: F.floor(F.greatest(l[k], r[k]) / F.pow(F.lit(2.0), F.col("__level"))).cast("long")
    return pairs.where((corner("x0") == F.col("__x")) & (corner("y0") == F.col("__y"))).drop("__level", "__x", "__y", "__own", "__other")


def first_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_box: str, right_id: str, right_box: str, order: list[str], rows: int | None = None) -> DataFrame:
    """left's keys and left_id (that name a row), and right_id of the first box in `order` (columns of right) that it overlaps; null where there is none."""
    pairs = overlapping(left.select(*keys, left_id, left_box), right, keys, left_box, right_box, rows)
    best = pairs.groupBy(*keys, left_id).agg(F.min(F.struct(*order, F.col(right_id))).alias("__first"))
    names = {k: f"__k{i}" for i, k in enumerate([*keys, left_id])}
    best = best.withColumnsRenamed(names)
    on = [left[k].eqNullSafe(best[n]) for k, n in names.items()]
    return left.select(*keys, left_id).join(best, on, "left").select(*(left[k] for k in [*keys, left_id]), F.col(f"__first.{right_id}").alias(right_id))
