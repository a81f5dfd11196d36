"""Running totals and exact quantiles over all rows, without one task seeing all of them.

A window without partition keys would pull every row into one task. Here rows are first
counted per distinct value (ties, however many, become one row), dealt into as many ranges as
their number asks for, and each range adds its own running total to the total of the ranges
before it. Only one total per range is ever in one place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.session import staged


def running_totals(
    df: DataFrame,
    value: str,
    measures: dict[str, Column],
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """One row per distinct `value`: each measure, and `cum_<measure>` up to and with it.

    `measures` are aggregates over the rows of a value, such as counts. The ranges are the
    partitions of a range shuffle, whose number follows the data where `ranges` is not given;
    they are staged with their number, so both uses see the same ranges.
    """
    per_value = df.where(F.col(value).isNotNull()).groupBy(value).agg(
        *[m.alias(n) for n, m in measures.items()]
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    dealt = per_value.repartitionByRange(ranges, order) if ranges else per_value.repartitionByRange(order)
    placed = staged(dealt.withColumn("__slot", F.spark_partition_id()), "values")
    totals = placed.groupBy("__slot").agg(*[F.sum(n).alias(f"__sum_{n}") for n in measures])
    before = Window.partitionBy(F.lit(1)).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__slot",
        *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__off_{n}") for n in measures],
    )
    inside = Window.partitionBy("__slot").orderBy(order)
    joined = placed.join(offsets, "__slot")
    return joined.select(
        value,
        *measures,
        *[(F.col(f"__off_{n}") + F.sum(n).over(inside)).alias(f"cum_{n}") for n in measures],
    )


#: Rank error of the sketch is one in so many; its memory grows with it.
SKETCH = 10_000
#: Distinct values of a bracket that are put in order in one task; more are bracketed again. At least `SKETCH`.
ORDERED = 1 << 18


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row with the interpolated quantiles of `value`, as `percentile` defines them.

    A mergeable quantile sketch brackets the ranks in one map-side pass. A second pass counts
    what is below each bracket and keeps what is inside by value, some six rows in `SKETCH`;
    where these still have many values, they are bracketed again. So the scores are neither
    sorted nor shuffled; up to `SKETCH` rows are all kept.
    """
    kind = df.schema[value].dataType.simpleString()
    known = df.where(F.col(value).isNotNull()).select(F.col(value).alias("value"))
    rows = known.select(F.explode(F.array(*[F.lit(i) for i in range(len(probs))])).alias("at"), "value")
    #: By quantile: where its ranks lie among the rows that are left, as a share and, once known, a rank.
    share = {i: float(p) for i, p in enumerate(probs)}
    rank: dict[int, int] = {}
    places: list[float] = []
    while True:
        mine = {at: F.when(F.col("at") == at, F.col("value")) for at in share}
        found = rows.agg(*[
            F.struct(
                F.count(mine[at]).alias("n"), F.min(mine[at]).alias("least"), F.max(mine[at]).alias("most"),
                F.percentile_approx(mine[at], [max(0.0, p - 3 / SKETCH), min(1.0, p + 3 / SKETCH)], F.lit(SKETCH)).alias("near"),
            ).alias(f"b{at}")
            for at, p in share.items()
        ]).first()
        bounds = {at: found[f"b{at}"] for at in share}
        if not bounds[0]["n"]:
            return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(n) for n in names])
        if not places:
            places = [p * (bounds[0]["n"] - 1) for p in share.values()]
            rank = {at: math.floor(place) for at, place in enumerate(places)}
        few = {at: b["n"] <= SKETCH for at, b in bounds.items()}
        low = {at: b["least"] if few[at] else b["near"][0] for at, b in bounds.items()}
        high = {at: b["most"] if few[at] else b["near"][1] for at, b in bounds.items()}
        side = lambda ends: F.element_at(F.create_map(*[x for at in share for x in (F.lit(at), F.lit(ends[at]).cast(kind))]), F.col("at"))
        kept = rows.where(F.col("value") <= side(high)).withColumn("inside", F.when(F.col("value") >= side(low), F.col("value")))
        counted = staged(kept.groupBy("at", "inside").agg(F.count(F.lit(1)).alias("n")), "bracketed")
        sizes = {r["at"]: r for r in counted.groupBy("at").agg(
            F.sum(F.when(F.col("inside").isNull(), F.col("n")).otherwise(0)).alias("below"),
            F.sum(F.when(F.col("inside").isNotNull(), F.col("n"))).alias("rows"), F.count("inside").alias("kinds"),
        ).collect()}
        rank = {at: r - sizes[at]["below"] for at, r in rank.items()}
        counted = counted.where("inside IS NOT NULL")
        if max(r["kinds"] for r in sizes.values()) <= ORDERED:
            break
        rows = staged(kept.where("inside IS NOT NULL").select("at", "value"), "bracketed-rows")
        share = {at: rank[at] / max(1, sizes[at]["rows"] - 1) for at in share}
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("at").orderBy("inside")))
    first = F.col("upto") - F.col("n")

    def value_at(at: int, place: int) -> Column:
        return F.max(F.when((F.col("at") == at) & (first <= place) & (F.lit(place) < F.col("upto")), F.col("inside")))

    out = []
    for at, (place, name) in enumerate(zip(places, names)):
        below, above = value_at(at, rank[at]), value_at(at, rank[at] + (math.ceil(place) > math.floor(place)))
        out.append((below + (above - below) * F.lit(place - math.floor(place))).alias(name))
    return upto.agg(*out)
