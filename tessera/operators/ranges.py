"""Scans along the rows of a file by ranges of rows, so that no task holds a file.

Every range is summed up by itself, the sums are scanned the same way, level by level, and each range then
goes over its own rows once more with what came before it.  A range has ``size`` places at most, a level
that many times fewer rows than the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.readers import broadcast_if_small, once

SIZE = 256


def step(after: list[Column]) -> Column:
    """A transition map of up to four states as one number: ``after[s]`` is the state that follows s."""
    bits = [F.call_function("shiftleft", a.cast("int"), F.lit(2 * s)) for s, a in enumerate(after)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def follow(steps: Column, state: Column) -> Column:
    return F.call_function("shiftright", steps, (state * 2).cast("int")).bitwiseAND(3)


def states(rows: DataFrame, by: list[str], pos: str, steps: str, size: int = SIZE) -> DataFrame:
    """rows with ``state``: the state before each row of its file (by), in order of ``pos``, from state 0.

    ``steps`` names a column of transition maps.  Maps of a range compose to one map, as composition is
    associative; those of all ranges are scanned in the same way.
    """
    ranges = F.floor(F.col(pos) / size).alias("_range")
    member = F.struct(F.col(pos).alias("at"), F.col(steps).alias("steps"), F.struct(*rows.columns).alias("row"))
    groups = rows.groupBy(*by, ranges).agg(F.array_sort(F.collect_list(member)).alias("_members"))
    then = lambda a, b: step([follow(b, follow(a, F.lit(s))) for s in range(4)])
    groups = once(groups.withColumn("_steps", F.aggregate("_members", step([F.lit(s) for s in range(4)]), lambda a, m: then(a, m["steps"]))))
    places = groups.select(*by, "_range", "_steps")
    if places.groupBy(*by).count().filter("count > 1").isEmpty():
        before = places.select(*by, "_range", F.lit(0).alias("state"))
    else:
        before = states(places, by, "_range", "_steps", size).select(*by, "_range", "state")
    met = _joined(groups, broadcast_if_small(before), [*by, "_range"])
    seen = F.aggregate(
        "_members", F.struct(F.col("state").alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, m: F.struct(follow(m["steps"], a["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"],
    )
    return met.select(F.explode(F.arrays_zip("_members", seen.alias("s"))).alias("m")).select("m._members.row.*", F.col("m.s").alias("state"))


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equal keys, nulls too."""
    names = {k: f"_k_{n}" for n, k in enumerate(keys)}
    b = b.withColumnsRenamed(names)
    on = None
    for k, n in names.items():
        on = F.col(k).eqNullSafe(F.col(n)) if on is None else on & F.col(k).eqNullSafe(F.col(n))
    return a.join(b, on, how).drop(*names.values())


def carried(rows: DataFrame, by: list[str], pos: str, value: str, name: str, inclusive: bool = False, size: int = SIZE) -> DataFrame:
    """rows with ``name``: the last value that is not null before each row of its file, or up to it."""
    rows = rows.withColumn("_range", F.floor(F.col(pos) / size))
    ends = once(rows.groupBy(*by, "_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(pos))).alias("_end")))
    if ends.groupBy(*by).count().filter(F.col("count") > size).isEmpty():
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        before = ends.withColumn("_start", F.last("_end", ignorenulls=True).over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    else:
        before = carried(ends.withColumnRenamed("_range", "_place"), by, "_place", "_end", "_start", size=size).withColumnRenamed("_place", "_range")
    met = _joined(rows, broadcast_if_small(before.select(*by, "_range", "_start")), [*by, "_range"])
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(*by, "_range").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return met.withColumn("_out", F.coalesce(own, "_start")).drop("_range", "_start").withColumnRenamed("_out", name)
