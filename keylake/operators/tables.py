"""Sorted tables and levels: statistics, overlaps, and what to compact.

Table statistics are one row a table, level statistics one row a level (seven at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keylake.functions.sizes import SUFFIX, octets, value_log_size
from keylake.log import Options
from keylake.operators import ranges
from keylake.operators.latest import dead, latest
from keylake.storage import written


def table_stats(log: DataFrame, table: Column, now: int) -> DataFrame:
    """table_id, key range, counts, newest version, bytes and stale bytes of each table."""
    v = F.coalesce(octets("value"), F.lit(0))
    size = value_log_size(F.col("key"), F.col("value"), F.col("ttl"))
    stale = F.when(dead(now), octets("key") + SUFFIX + v + 8)
    return log.groupBy(table.alias("table_id")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("key_count"), F.max("version").alias("max_version"), F.sum(size).alias("size"), F.coalesce(F.sum(stale), F.lit(0)).alias("stale_size"))


def level_stats(tables: DataFrame) -> DataFrame:
    """tables: of table_stats with level and in_flight. One row a level."""
    return tables.groupBy("level").agg(F.count("*").alias("n_tables"), F.sum("size").alias("size"), F.sum("stale_size").alias("stale_size"), F.coalesce(F.sum(F.when(F.col("in_flight"), F.col("size"))), F.lit(0)).alias("in_flight_size"))


def key_range(tables: DataFrame, by: str = "level") -> DataFrame:
    """The range of keys that a set of tables covers."""
    return tables.groupBy(by).agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"))


def ranges_overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Closed ranges. A range without ends is empty: the first overlaps all if empty, the second none."""
    return (a_lo.isNull() & a_hi.isNull()) | (~(b_lo.isNull() & b_hi.isNull()) & (a_lo <= b_hi) & (a_hi >= b_lo))


def overlapping(tables: DataFrame) -> DataFrame:
    """Each table with the tables of the next level that overlap it."""
    t = written(tables.select("table_id", "level", "min_key", "max_key"))
    below = t.select(F.col("table_id").alias("below_id"), (F.col("level") - 1).alias("above"), F.col("min_key").alias("b_lo"), F.col("max_key").alias("b_hi"))
    return ranges.overlaps(t, below, "min_key", "max_key", "b_lo", "b_hi", ("level", "above")).select("table_id", "level", "below_id")


def tables_for_keys(keys: DataFrame, tables: DataFrame) -> DataFrame:
    """Each key with the tables whose range holds it."""
    t = tables.select("table_id", "level", "min_key", "max_key")
    return ranges.stabbed(keys.select("key"), t, "key", "min_key", "max_key").select("key", "table_id", "level")


def conflicting(plans: DataFrame, in_flight: DataFrame) -> DataFrame:
    """The plans (plan_id, level, lo, hi) that overlap a range under way at their level. A plan without ends overlaps all, a range under way without ends none but such plans."""
    busy = in_flight.select(F.col("level").alias("l"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    whole = plans.filter("lo is null and hi is null").join(busy.select("l").distinct(), F.col("level") == F.col("l"), "left_semi")
    hit = ranges.overlaps(plans.select("plan_id", "level", "lo", "hi"), busy, "lo", "hi", "b_lo", "b_hi", ("level", "l")).select("plan_id").distinct()
    return plans.join(hit, "plan_id", "left_semi").unionByName(whole)


def level_zero_to_base(tables: DataFrame, base: int) -> DataFrame:
    """What level 0 gives to the base level: the oldest tables, each while it overlaps the range of those before, with the base level's tables that overlap their range. role: top or bottom."""
    order = W.orderBy("max_version", "table_id")  # over the tables of level 0
    before = order.rowsBetween(W.unboundedPreceding, -1)
    top = tables.filter((F.col("level") == 0) & ~F.col("in_flight")).select("table_id", "level", "min_key", "max_key", "max_version", F.min("min_key").over(before).alias("lo"), F.max("max_key").over(before).alias("hi"))
    apart = F.coalesce((F.col("min_key") > F.col("hi")) | (F.col("max_key") < F.col("lo")), F.lit(False))
    top = written(top.withColumn("stopped", F.max(apart).over(order)).filter("not stopped"))
    covered = top.agg(F.min("min_key").alias("t_lo"), F.max("max_key").alias("t_hi"))
    bottom = tables.filter(F.col("level") == base).select("table_id", "level", "min_key", "max_key").join(F.broadcast(covered), (F.col("min_key") <= F.col("t_hi")) & (F.col("max_key") >= F.col("t_lo")))  # the right side is one row
    mine = ["table_id", "level", "min_key", "max_key"]
    return top.select(*mine, F.lit("top").alias("role")).unionByName(bottom.select(*mine, F.lit("bottom").alias("role")))


def level_to_next(tables: DataFrame, level: int, in_flight: DataFrame) -> DataFrame:
    """The plan of a level: its oldest table whose range, and the range of the next level's tables that it overlaps, are free of ranges under way (level, lo, hi). One row or none."""
    mine = written(tables.filter(F.col("level") == level).select("table_id", "level", "min_key", "max_key", "max_version"))
    below = tables.filter(F.col("level") == level + 1).select(F.col("table_id").alias("below_id"), F.col("min_key").alias("b_lo"), F.col("max_key").alias("b_hi"))
    met = ranges.overlaps(mine.select("table_id", "min_key", "max_key"), below, "min_key", "max_key", "b_lo", "b_hi").groupBy("table_id").agg(F.count("*").alias("n_bottom"), F.min("b_lo").alias("next_lo"), F.max("b_hi").alias("next_hi"))
    plans = written(mine.join(met, "table_id", "left").select("table_id", "max_version", F.col("min_key").alias("this_lo"), F.col("max_key").alias("this_hi"), F.coalesce("n_bottom", F.lit(0)).alias("n_bottom"), F.coalesce("next_lo", "min_key").alias("next_lo"), F.coalesce("next_hi", "max_key").alias("next_hi")))
    of = lambda a, l: plans.select(F.col("table_id").alias("plan_id"), F.lit(l).cast("long").alias("level"), F.col(f"{a}_lo").alias("lo"), F.col(f"{a}_hi").alias("hi"))
    taken = conflicting(of("this", level).unionByName(of("next", level + 1)), in_flight).select(F.col("plan_id").alias("table_id")).distinct()
    return plans.join(taken, "table_id", "left_anti").orderBy("max_version", "table_id").limit(1)


def reserved(in_flight: DataFrame, plans: DataFrame) -> DataFrame:
    """Ranges under way (level, lo, hi) with those of plans from level_to_next (with their level) added, both of the level and of the next."""
    return in_flight.select("level", "lo", "hi").unionByName(_ranges_of(plans))


def released(in_flight: DataFrame, plans: DataFrame) -> DataFrame:
    """Ranges under way without those of plans that are done: of equal ranges one goes for each plan."""
    return in_flight.select("level", "lo", "hi").exceptAll(_ranges_of(plans))


def _ranges_of(plans: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("level").alias("level"), F.col("this_lo").alias("lo"), F.col("this_hi").alias("hi")), F.struct((F.col("level") + 1).alias("level"), F.col("next_lo").alias("lo"), F.col("next_hi").alias("hi")))
    return plans.select(F.inline(both))


def file_targets(levels: DataFrame, options: Options) -> DataFrame:
    """level and file_bytes: level 0 has the write buffer's size, levels down to the base the table size, and each level below `table_multiplier` times that of the one above."""
    deepest = compaction_priorities(levels, options).filter(F.col("target") <= options.base_level_bytes).agg(F.coalesce(F.max("level"), F.lit(0)).alias("deepest"))
    below = F.greatest(F.col("level") - F.col("deepest"), F.lit(0))
    size = F.when(F.col("level") == 0, F.lit(options.memtable_bytes)).otherwise(options.base_table_bytes * F.pow(F.lit(options.table_multiplier), below))
    return deepest.select("deepest", F.explode(F.sequence(F.lit(0), F.lit(options.levels - 1))).alias("level")).select("level", size.cast("long").alias("file_bytes"))


def compaction_priorities(levels: DataFrame, options: Options) -> DataFrame:
    """level, target, base_level, score and adjusted score of every level, from level statistics. One row is aggregated; the rest is arithmetic on it."""
    n, last = options.levels, options.levels - 1
    of = lambda c, i: F.coalesce(F.sum(F.when(F.col("level") == i, F.col(c))), F.lit(0))
    row = levels.agg(*[of("size", i).alias(f"s{i}") for i in range(n)], *[of("in_flight_size", i).alias(f"f{i}") for i in range(n)], of("n_tables", 0).alias("n0"))
    s = [F.col(f"s{i}") for i in range(n)]
    # What the bottom level's size allows each level, a multiple less a level up.
    allowed = [F.floor(s[last] / options.level_multiplier ** (last - i)) for i in range(n)]
    row = row.select("*", *[F.greatest(allowed[i], F.lit(options.base_level_bytes)).alias(f"t{i}") for i in range(1, n)])
    t = [None, *[F.col(f"t{i}") for i in range(1, n)]]
    deepest = F.greatest(*[F.when(t[i] <= options.base_level_bytes, i).otherwise(0) for i in range(1, n)])
    row = row.withColumn("base", deepest)
    for i in range(2, last):  # empty levels below the base are passed over
        row = row.withColumn("base", F.when((F.col("base") == i - 1) & (s[i] == 0), i).otherwise(F.col("base")))
    step = F.lit(False)
    for i in range(1, last):
        step = step | ((F.col("base") == i) & (s[i] == 0) & (s[i + 1] < t[i + 1]))
    row = row.withColumn("base", F.when(step, F.col("base") + 1).otherwise(F.col("base")))
    score = [F.col("n0") / options.level_zero_tables, *[(s[i] - F.col(f"f{i}")) / t[i] for i in range(1, n)]]
    row = row.select("base", *[f"t{i}" for i in range(1, n)], F.array(*score).alias("scores"))
    of_level = F.col("scores")[F.col("level")]
    following = F.when(F.col("level") == 0, F.col("scores")[F.col("base")]).when(F.col("level") >= F.col("base"), F.try_element_at("scores", F.col("level") + 2))
    rows = row.select("*", F.posexplode(F.array(F.lit(None).cast("long"), *[F.col(f"t{i}").cast("long") for i in range(1, n)])).alias("level", "target"))
    return rows.select("level", "target", F.col("base").alias("base_level"), F.round(of_level, 6).alias("score"), F.round(F.when((of_level >= 1) & following.isNotNull(), of_level / F.greatest(following, F.lit(0.01))).otherwise(of_level), 6).alias("adjusted"))


def compaction_order(priorities: DataFrame, options: Options) -> DataFrame:
    """The levels worth compacting: level 0 first, then by falling adjusted score; never the last one."""
    return priorities.filter((F.col("score") >= 1) & (F.col("level") < options.levels - 1)).orderBy(F.when(F.col("level") == 0, 0).otherwise(1), F.col("adjusted").desc(), "level")


def stale_candidates(tables: DataFrame, level: int, least_stale: int) -> DataFrame:
    """Tables of the last level worth rewriting alone: most stale bytes first."""
    return tables.filter((F.col("level") == level) & (F.col("stale_size") >= least_stale)).select("table_id", "stale_size", "max_version").orderBy(F.col("stale_size").desc(), "table_id")


def level_zero_candidates(tables: DataFrame, file_bytes: int, least: int = 4) -> DataFrame:
    """Small tables of level 0 that aren't under way, oldest first; none if fewer than `least`."""
    picked = tables.filter((F.col("level") == 0) & (F.col("size") < 2 * file_bytes) & ~F.col("in_flight"))
    enough = picked.agg((F.count("*") >= least).alias("enough"))
    return picked.crossJoin(F.broadcast(enough)).filter("enough").select("table_id", "size", "max_version").orderBy("max_version", "table_id")  # the right side is one row


def split_points(bottom: DataFrame) -> DataFrame:
    """Split ranges over the bottom tables, in the order of their keys: a cut after every width-th one, width = max(3, ceil(n / 5)). One row a table goes in."""
    n = bottom.agg(F.count("*").alias("n"))
    order = W.orderBy("min_key", "table_id")  # over the tables of one compaction
    numbered = bottom.select("table_id", "min_key", "max_key", F.row_number().over(order).alias("rn")).crossJoin(F.broadcast(n))  # the right side is one row
    width = F.greatest(F.lit(3), F.ceil(F.col("n") / 5))
    cuts = numbered.withColumn("width", width).filter("(rn - 1) % width = width - 1 or rn = n")
    cuts = cuts.withColumn("hi", F.when(F.col("rn") == F.col("n"), F.lit(None)).otherwise(F.col("max_key")))
    by = W.orderBy("rn")
    return cuts.select((F.row_number().over(by) - 1).alias("split"), F.lag("max_key").over(by).alias("lo"), "hi")


def compacted(log: DataFrame, now: int | None = None) -> DataFrame:
    """What a full compaction keeps: the latest row of each key, at the last level (now given) without dead rows."""
    out = latest(log)
    return out if now is None else out.filter(~dead(now))


def write_sorted(log: DataFrame, path: str, max_rows: int = 1_000_000, splits: DataFrame | None = None, filters_for: int | None = None, mode: str = "errorifexists") -> None:
    """Tables of disjoint, sorted key ranges: readers skip row groups by their least and greatest keys.

    splits (of split_points): rows of a split range are dealt further by their hash, `max_rows` of them to a file at most. filters_for: files
    get Parquet's own Bloom filter on the key, for so many distinct keys a file; gets then skip files that can't have a key.
    """
    newest = [F.col("version").desc(), F.col("seq").desc()]
    if splits is None:
        rows = log.repartitionByRange("key")
    else:
        upper = splits.filter("hi is not null").select("hi").distinct()
        rows = split_of(log, upper)
    writer = rows.sortWithinPartitions("key", *newest).write.option("maxRecordsPerFile", max_rows).mode(mode)
    if filters_for is not None:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.expected.ndv#key", filters_for)
    (writer if splits is None else writer.partitionBy("split")).parquet(path)


def split_of(log: DataFrame, upper: DataFrame) -> DataFrame:
    """log with `split`: how many of the split ranges (upper: hi) end before the row's key; ranged by split and key, so that a split of any size is dealt over many tasks."""
    places = upper.orderBy("hi").agg(F.sort_array(F.collect_list("hi")).alias("ends"))  # at most five splits a compaction and one row
    out = log.join(F.broadcast(places), F.lit(True)).withColumn("split", F.size(F.filter("ends", lambda e: e < F.col("key")))).drop("ends")
    return out.repartitionByRange("split", "key")
