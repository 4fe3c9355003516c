"""Linear interpolation of one time axis onto another."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cubelark.cube import Cube, CubeError

#: Target times that travel in one row, and rows of them that are broadcast.
CHUNK, FEW = 1 << 16, 1 << 10


def resample(cube: Cube, target: Cube) -> Cube:
    """Values at the target's times: linear between the steps around them, clamped at both ends.

    The steps of each cell and the target's times are put into one order, in which a time finds the steps
    before and after it. A missing neighbour gives NULL. Target times travel to the cells in rows of many;
    that every cell meets every one of them is what resampling gives.
    """
    if "t" not in cube.axes or "t" not in target.axes:
        raise CubeError("resampling needs two time axes")
    cell = [a for a in cube.axes if a != "t"]
    times = target.own.steps("t").withColumnRenamed("t", "_t")
    if cell:
        count = times.count()
        chunks = times.groupBy(F.pmod(F.xxhash64("_t"), F.lit(count // CHUNK + 1)).alias("_chunk")).agg(F.collect_list("_t").alias("_times"))
        chunks = F.broadcast(chunks) if count // CHUNK < FEW else chunks
        wanted = cube.df.select(*cell).distinct().join(chunks).select(*cell, F.explode("_times").alias("t"))
    else:  # an axis alone
        wanted = times.withColumnRenamed("_t", "t")
    steps = cube.df.select("t", *cell, F.struct("t", *cube.values).alias("_step"))
    both = steps.unionByName(wanted.withColumn("_step", F.lit(None)))
    # a step comes before a time that is equal to it
    order = Window.partitionBy(*cell).orderBy("t", F.col("_step").isNull())
    before = F.last("_step", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_step", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = both.withColumn("_a", before).withColumn("_b", after).where("_step is null and (_a is not null or _b is not null)")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    share = (seconds("t") - seconds("_a.t")) / (seconds("_b.t") - seconds("_a.t"))

    def value(v: str):
        a, b = F.col(f"_a.{v}"), F.col(f"_b.{v}")
        ended = F.when(F.col("_a").isNull(), b).otherwise(a)
        return F.when(F.col("_a").isNull() | F.col("_b").isNull() | (F.col("t") == F.col("_a.t")), ended).otherwise(a * (1 - share) + b * share)

    return Cube(rows.select("t", *cell, *(value(v).alias(v) for v in cube.values)), cube.axes, cube.values)
