"""Range joins: points and the ranges that hold them, without comparing all of both.

Points and the ends of ranges are dealt to parts by range and sorted there. A part is cut into cells of
`PER_CELL` points, however many ranges begin there. Each range is repeated for the cells from its first point to its last one,
and meets the points by an equality of cells; points are compared with a range in its first and last cell only.
So the work is the pairs that come out, the PER_CELL-th of them as repeated ranges, and at most two cells' points a range.
Cells, not bytes, are dealt to tasks: few short rows can make very many pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keylake.storage import ranged, written

PER_CELL = 256
BEGIN, POINT, END = 0, 1, 2


def _cells(rows: DataFrame) -> DataFrame:
    """rows (at, kind, ...) with their cell: cells are numbered in the order of (at, kind). A range's begin has the cell of the next point or one before, its end that of the last point."""
    rows = ranged(rows, "at", "kind")
    point = F.col("kind") == POINT
    met = F.coalesce(F.sum(point.cast("long")).over(W.partitionBy("part").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = rows.withColumn("cell", F.floor((met - (F.col("kind") == END).cast("long")) / PER_CELL))
    parts = rows.groupBy("part").agg(F.ceil(F.count(F.when(point, 1)) / PER_CELL).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # over one row a part
    return local.join(parts.select("part", before.alias("first")), "part").withColumn("cell", F.col("cell") + F.col("first")).drop("part", "first")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to a fixed number of tasks, which adaptive execution doesn't merge for having few bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def stabbed(points: DataFrame, ranges: DataFrame, at: str, lo: str, hi: str, same: tuple[str, str] | None = None) -> DataFrame:
    """All columns of each pair of a point and a closed range that holds it. Points and ranges with nulls there pair with nothing; column names must differ, also from cell, inner, same and range_no.

    same: a column of points and one of ranges that must be equal too.
    """
    r = written(ranges.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull()).withColumn("range_no", F.monotonically_increasing_id()))
    none = F.lit(None)
    own = F.struct(*points.columns)
    p = points.filter(F.col(at).isNotNull()).select(F.col(at).alias("at"), F.lit(POINT).alias("kind"), none.cast("long").alias("range_no"), own.alias("p"))
    kind_of = p.schema["p"].dataType
    ends = [r.select(F.col(c).alias("at"), F.lit(k).alias("kind"), "range_no", none.cast(kind_of).alias("p")) for c, k in ((lo, BEGIN), (hi, END))]
    rows = written(_cells(p.unionByName(ends[0]).unionByName(ends[1])))
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("cell")))
    spans = _dealt(rows.filter(F.col("kind") != POINT), "range_no").groupBy("range_no").agg(of(BEGIN).alias("a"), of(END).alias("b")).filter("a <= b")  # others hold no point
    wide = _dealt(r, "range_no").join(spans.hint("merge"), "range_no").withColumn("cell", F.explode(F.sequence("a", "b"))).withColumn("inner", (F.col("cell") > F.col("a")) & (F.col("cell") < F.col("b")))
    wide = wide.select("cell", "inner", F.col(same[1] if same else "cell").alias("same"), *ranges.columns)
    met = rows.filter(F.col("kind") == POINT).select("cell", F.col(f"p.{same[0]}" if same else "cell").alias("same"), "p.*")
    # The points of a cell, PER_CELL at most, are those kept while its ranges pass.
    pairs = _dealt(wide, "cell", "same").join(_dealt(met, "cell", "same").hint("merge"), ["cell", "same"])
    return pairs.filter(F.col("inner") | ((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi)))).select(*points.columns, *ranges.columns)


def overlaps(left: DataFrame, right: DataFrame, lo: str, hi: str, other_lo: str, other_hi: str, same: tuple[str, str] | None = None) -> DataFrame:
    """All pairs of a range of left and one of right that overlap: either right begins in left, or left begins in right, later than right.

    same: a column of left and one of right that must be equal too.
    """
    left = left.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull())
    right = right.filter(F.col(other_lo).isNotNull() & F.col(other_hi).isNotNull())
    inside = stabbed(right, left, other_lo, lo, hi, same and same[::-1])
    later = stabbed(left, right, lo, other_lo, other_hi, same).filter(F.col(lo) > F.col(other_lo))
    return inside.select(*left.columns, *right.columns).unionByName(later.select(*left.columns, *right.columns))


def beside(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """Per distinct probe the nearest keys: gt, ge, lt and le. Both tables may be of any size; a null probe is left out."""
    k = keys.select(F.col("key").alias("at"), F.lit(POINT).alias("kind"))
    p = probes.select(F.col("probe").alias("at")).filter("at is not null").distinct()
    # A probe is asked before a key like it, for lt and ge, and after it, for le and gt.
    rows = ranged(k.unionByName(p.select("at", F.lit(BEGIN).alias("kind"))).unionByName(p.select("at", F.lit(END).alias("kind"))), "at", "kind")
    key = F.when(F.col("kind") == POINT, F.col("at"))
    ends = rows.groupBy("part").agg(F.max(key).alias("high"), F.min(key).alias("low"))
    # What follows is what comes before in the falling order: a frame that ends at the last row is read anew for every row.
    so_far = lambda order: order.rowsBetween(W.unboundedPreceding, -1)
    up, down = so_far(W.orderBy("part")), so_far(W.orderBy(F.col("part").desc()))  # over one row a part
    across = ends.select("part", F.last("high", True).over(up).alias("before"), F.last("low", True).over(down).alias("after"))
    own = W.partitionBy("part")
    rising, falling = so_far(own.orderBy("at", "kind")), so_far(own.orderBy(F.col("at").desc(), F.col("kind").desc()))
    near = rows.select("part", "at", "kind", F.last(key, True).over(rising).alias("l"), F.last(key, True).over(falling).alias("g"))
    near = near.filter(F.col("kind") != POINT).join(across, "part").select("at", "kind", F.coalesce("l", "before").alias("l"), F.coalesce("g", "after").alias("g"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return near.groupBy(F.col("at").alias("probe")).agg(of(END, "g").alias("gt"), of(BEGIN, "g").alias("ge"), of(BEGIN, "l").alias("lt"), of(END, "l").alias("le"))
