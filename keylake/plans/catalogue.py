"""Queries over the driver's tables, one or more for each operator, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keylake.functions import sizes, sketches
from keylake.log import NOW, Options, kv_log, order_log
from keylake.operators import cutting, latest, manifest, reads, tables, valuelog, writes
from keylake.sources.files import table
from keylake.storage import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}

#: Parameters of the queries.
TABLE_ROWS, FILE_ROWS, BLOCK_BYTES, MEMTABLE_BYTES, LOG_BYTES, LOG_ROWS = 500, 1000, 1024, 8000, 12_000, 180
LEVELS = Options(base_level_bytes=20_000, base_table_bytes=5_000, level_zero_tables=1)

KV = """kv AS (
  SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') || '/' || event_type AS key, props AS value,
         CASE WHEN value < 20 THEN 'DEL' ELSE 'PUT' END AS op,
         CASE WHEN event_id % 3 = 0 THEN 0 ELSE epoch_us(ts) // 1000000 + 86400 END AS ttl,
         epoch_us(ts) AS version, event_id AS seq
  FROM events)"""
LATEST = f"""{KV}, latest AS (
  SELECT key, value, op, ttl, version, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, seq DESC) AS rn FROM kv) WHERE rn = 1)"""
LIVE = f"{LATEST}, live AS (SELECT * FROM latest WHERE op <> 'DEL' AND (ttl = 0 OR ttl > {NOW}))"
UV = "greatest(1, CAST(ceil(length(bin({x})) / 7.0) AS BIGINT))"


def _uv(x: str) -> str:
    return UV.format(x=x)


RECORD = f"1 + {_uv('strlen(key) + 8')} + {_uv('strlen(value)')} + {_uv('ttl')} + strlen(key) + 8 + strlen(value) + 4"
RECORDS = f"""{KV}, sized AS (SELECT *, seq // {FILE_ROWS} AS fid, {RECORD} AS len FROM kv),
records AS (SELECT *, coalesce(CAST(sum(len) OVER (PARTITION BY fid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset" FROM sized)"""
NEWEST = f"""{RECORDS}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, seq DESC) AS rn FROM records) WHERE rn = 1)"""
ALIVE = f"""{NEWEST}, alive AS (
  SELECT r.*, n.seq IS NOT NULL AND r.op <> 'DEL' AND (r.ttl = 0 OR r.ttl > {NOW}) AS alive FROM records r LEFT JOIN newest n ON n.key = r.key AND n.fid = r.fid AND n."offset" = r."offset"),
discards AS (SELECT fid, CAST(sum(len) AS BIGINT) AS total, CAST(coalesce(sum(len) FILTER (WHERE NOT alive), 0) AS BIGINT) AS discard FROM alive GROUP BY fid)"""
TABLES = f"""{KV}, tab AS (
  SELECT seq // {TABLE_ROWS} AS table_id, min(key) AS min_key, max(key) AS max_key, count(*) AS key_count, max(version) AS max_version,
         CAST(sum({RECORD}) AS BIGINT) AS size,
         CAST(coalesce(sum(strlen(key) + 8 + strlen(value) + 8) FILTER (WHERE op = 'DEL' OR (ttl <> 0 AND ttl <= {NOW})), 0) AS BIGINT) AS stale_size
  FROM kv GROUP BY 1),
tabs AS (SELECT *, least(table_id % 10, 6) AS level, table_id % 7 = 3 AS in_flight FROM tab),
levels AS (SELECT level, count(*) AS n_tables, CAST(sum(size) AS BIGINT) AS size, CAST(sum(stale_size) AS BIGINT) AS stale_size, CAST(coalesce(sum(size) FILTER (WHERE in_flight), 0) AS BIGINT) AS in_flight_size FROM tabs GROUP BY level)"""
CHANGES = """changes AS (
  SELECT event_id // 5 AS set_seq, event_id % 5 AS pos, (event_id * 7919) % 400 AS table_id, CASE WHEN value < 35 THEN 'DELETE' ELSE 'CREATE' END AS op, event_id % 7 AS level FROM events),
state AS (SELECT table_id, level FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY set_seq DESC, pos DESC) AS rn FROM changes) WHERE rn = 1 AND op = 'CREATE')"""


def query(name: str, sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[name] = f, sql
        return f

    return add


def _kv(spark: SparkSession, folder: str) -> DataFrame:
    return kv_log(table(spark, folder, "events"))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return valuelog.with_offsets(_kv(spark, folder), F.floor(F.col("seq") / FILE_ROWS))


def _tables(spark: SparkSession, folder: str) -> DataFrame:
    out = tables.table_stats(_kv(spark, folder), F.floor(F.col("seq") / TABLE_ROWS), NOW)
    return out.withColumn("level", F.least(F.col("table_id") % 10, F.lit(6))).withColumn("in_flight", F.col("table_id") % 7 == 3)


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    i = F.col("event_id")
    return e.select(F.floor(i / 5).alias("set_seq"), (i % 5).alias("pos"), (i * 7919 % 400).alias("table_id"), F.when(F.col("value") < 35, "DELETE").otherwise("CREATE").alias("op"), (i % 7).alias("level"))


ALL = "key, value, op, ttl, version, seq"


@query("kv_latest", f"WITH {LATEST} SELECT {ALL} FROM latest")
def _(s, d):
    return latest.latest(_kv(s, d))


@query("kv_live_scan", f"WITH {LIVE} SELECT {ALL} FROM live ORDER BY key")
def _(s, d):
    return reads.scan(_kv(s, d), NOW)


@query("kv_get", f"WITH {LIVE} SELECT {ALL} FROM live WHERE key = '00002/view'")
def _(s, d):
    return reads.get(_kv(s, d), "00002/view", NOW)


@query("kv_multi_get", f"WITH {LIVE} SELECT {ALL} FROM live WHERE key IN (SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '/purchase' FROM customer)")
def _(s, d):
    keys = table(s, d, "customer").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit("/purchase")).alias("key"))
    return reads.multi_get(_kv(s, d), keys, NOW)


@query("kv_deleted_keys", f"WITH {LATEST} SELECT key, version FROM latest WHERE op = 'DEL'")
def _(s, d):
    return latest.deleted_keys(_kv(s, d))


@query("kv_expired_keys", f"WITH {LATEST} SELECT key, ttl FROM latest WHERE ttl <> 0 AND ttl <= {NOW}")
def _(s, d):
    return latest.expired_keys(_kv(s, d), NOW)


@query("kv_prefix_scan", f"WITH {LIVE} SELECT {ALL} FROM live WHERE starts_with(key, '0000') ORDER BY key")
def _(s, d):
    return reads.prefix_scan(_kv(s, d), "0000", NOW)


@query("kv_range_scan", f"WITH {LIVE} SELECT {ALL} FROM live WHERE key >= '00004' AND key < '00012/s' ORDER BY key")
def _(s, d):
    return reads.range_scan(_kv(s, d), "00004", "00012/s", NOW)


PROBES = ["", "00000/click", "00003/view", "00005", "00007/zzz", "99999"]


@query("kv_neighbours", f"WITH {LIVE}, p AS (SELECT unnest({PROBES!r}) AS probe) SELECT probe, min(key) FILTER (WHERE key > probe) AS gt, min(key) FILTER (WHERE key >= probe) AS ge, max(key) FILTER (WHERE key < probe) AS lt, max(key) FILTER (WHERE key <= probe) AS le FROM p, live GROUP BY probe")
def _(s, d):
    return reads.neighbours(_kv(s, d), PROBES, NOW)


@query("kv_neighbours_of_table", f"WITH {LIVE}, p AS (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '/m' AS probe FROM customer) SELECT probe, min(key) FILTER (WHERE key > probe) AS gt, min(key) FILTER (WHERE key >= probe) AS ge, max(key) FILTER (WHERE key < probe) AS lt, max(key) FILTER (WHERE key <= probe) AS le FROM p, live GROUP BY probe")
def _(s, d):
    probes = table(s, d, "customer").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit("/m")).alias("probe"))
    return reads.neighbours(_kv(s, d), probes, NOW)


@query("kv_next_prev", f"WITH {LIVE} SELECT key, lag(key) OVER (ORDER BY key) AS prev_key, lead(key) OVER (ORDER BY key) AS next_key FROM live")
def _(s, d):
    return reads.with_neighbours(_kv(s, d), NOW)


@query("kv_first_last", f"WITH {LIVE} SELECT min(key) AS first_key, max(key) AS last_key FROM live")
def _(s, d):
    return reads.first_last(_kv(s, d), NOW)


@query("kv_reverse_topk", f"WITH {LIVE} SELECT {ALL} FROM live ORDER BY key DESC LIMIT 25")
def _(s, d):
    return reads.top_keys(_kv(s, d), 25, NOW)


@query("kv_reverse_scan", f"WITH {LIVE} SELECT {ALL} FROM live ORDER BY key DESC")
def _(s, d):
    return reads.scan(_kv(s, d), NOW, ascending=False)


@query("kv_info", f"WITH {LATEST} SELECT (SELECT count(*) FROM kv) AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE op <> 'DEL' AND (ttl = 0 OR ttl > {NOW})) AS n_live, count(*) FILTER (WHERE op = 'DEL') AS n_deleted, count(*) FILTER (WHERE ttl <> 0 AND ttl <= {NOW}) AS n_expired FROM latest")
def _(s, d):
    return reads.info(_kv(s, d), NOW)


@query("kv_versions_rank", f"WITH {KV} SELECT {ALL}, row_number() OVER (PARTITION BY key ORDER BY version DESC, seq DESC) AS rank FROM kv")
def _(s, d):
    return latest.ranked_versions(_kv(s, d))


@query("kv_version_history_count", f"WITH {KV} SELECT key, count(*) AS n_versions, count(*) FILTER (WHERE op = 'DEL') AS n_deletes, min(version) AS first_version, max(version) AS last_version FROM kv GROUP BY key")
def _(s, d):
    return latest.version_counts(_kv(s, d))


@query("kv_as_of", f"WITH {KV}, latest AS (SELECT {ALL} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, seq DESC) AS rn FROM kv WHERE version <= 1705276800000000) WHERE rn = 1) SELECT {ALL} FROM latest WHERE op <> 'DEL' AND (ttl = 0 OR ttl > 1705276800)")
def _(s, d):
    return latest.as_of(_kv(s, d), 1705276800000000, 1705276800)


@query("kv_order_lines_latest", """
WITH k AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '/' || l_linenumber AS key, epoch_us(l_shipdate) AS version, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem)
SELECT key, version, l_partkey AS part, l_suppkey AS supplier, l_quantity AS quantity, l_extendedprice AS price FROM k WHERE rn = 1""")
def _(s, d):
    out = latest.latest(order_log(table(s, d, "lineitem")))
    return out.select("key", "version", F.col("value.l_partkey").alias("part"), F.col("value.l_suppkey").alias("supplier"), F.col("value.l_quantity").alias("quantity"), F.col("value.l_extendedprice").alias("price"))


@query("kv_merge_tiers", f"WITH {KV}, t AS (SELECT *, version // 864000000000 AS tier FROM kv) SELECT {ALL}, tier FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier DESC, version DESC, seq DESC) AS rn FROM t) WHERE rn = 1")
def _(s, d):
    return writes.merged_by(_kv(s, d).withColumn("tier", F.floor(F.col("version") / 864_000_000_000)), "tier")


@query("kv_merge_three_tiers", f"""
WITH {KV}, t AS (SELECT *, 2 AS tier FROM kv WHERE seq % 3 = 0 UNION ALL SELECT *, 1 FROM kv WHERE seq % 3 = 1 UNION ALL SELECT *, 0 FROM kv WHERE seq % 3 = 2)
SELECT {ALL} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier DESC, version DESC, seq DESC) AS rn FROM t) WHERE rn = 1""")
def _(s, d):
    kv = _kv(s, d)
    return writes.merged([kv.filter(F.col("seq") % 3 == k) for k in range(3)])


BATCH_VERSION = 1_800_000_000_000_000


@query("kv_batch_upsert", f"""
WITH {KV}, b AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '/view' AS key, c_name AS value, 'PUT' AS op, 0 AS ttl, {BATCH_VERSION} AS version, c_custkey AS seq FROM customer),
a AS (SELECT * FROM kv UNION ALL SELECT * FROM b)
SELECT {ALL} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, seq DESC) AS rn FROM a) WHERE rn = 1 AND op <> 'DEL' AND (ttl = 0 OR ttl > {NOW})""")
def _(s, d):
    rows = table(s, d, "customer").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit("/view")).alias("key"), F.col("c_name").alias("value"), "c_custkey")
    return latest.live_rows(writes.appended(_kv(s, d), writes.puts(rows, BATCH_VERSION, F.col("c_custkey"))), NOW)


@query("kv_batch_delete", f"""
WITH {KV}, a AS (SELECT * FROM kv UNION ALL SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || '/click', NULL, 'DEL', 0, {BATCH_VERSION}, 0 FROM supplier)
SELECT {ALL} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, seq DESC) AS rn FROM a) WHERE rn = 1 AND op <> 'DEL' AND (ttl = 0 OR ttl > {NOW})""")
def _(s, d):
    keys = table(s, d, "supplier").select(F.concat(F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit("/click")).alias("key"))
    return latest.live_rows(writes.appended(_kv(s, d), writes.tombstones(keys, BATCH_VERSION)), NOW)


@query("kv_batch_limits", f"""
WITH {KV}, b AS (SELECT seq // 97 AS batch, count(*) AS n_rows, CAST(sum(CASE WHEN strlen(value) < 10 THEN strlen(key) + strlen(value) + 1 ELSE strlen(key) + 13 END) AS BIGINT) AS n_bytes, CAST(sum(21 + strlen(key) + strlen(value) + 4) AS BIGINT) AS request_bytes FROM kv GROUP BY 1)
SELECT *, n_rows >= 97 OR n_bytes >= 2000 AS too_big FROM b""")
def _(s, d):
    return writes.batch_sizes(_kv(s, d), F.floor(F.col("seq") / 97), Options(value_threshold=10, max_batch_count=97, max_batch_bytes=2000))


@query("kv_separation_route", "SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size, CASE WHEN coalesce(strlen(text), 0) < 1024 THEN 'inline' ELSE 'value_log' END AS place FROM documents")
def _(s, d):
    return writes.routed(table(s, d, "documents"), "text", 1024).select("doc_id", "size", "place")


@query("kv_separation_stats", "SELECT CASE WHEN coalesce(strlen(text), 0) < 1024 THEN 'inline' ELSE 'value_log' END AS place, count(*) AS n_rows, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS n_bytes, CAST(max(coalesce(strlen(text), 0)) AS BIGINT) AS largest FROM documents GROUP BY 1")
def _(s, d):
    return writes.route_stats(table(s, d, "documents"), "text", 1024)


@query("kv_first_seen", f"WITH {KV} SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) > 1 AS seen FROM kv")
def _(s, d):
    return writes.first_seen(_kv(s, d))


@query("kv_vlog_offsets", f'WITH {RECORDS} SELECT fid, "offset", len, key, seq FROM records')
def _(s, d):
    return _records(s, d).select("fid", "offset", "len", "key", "seq")


@query("kv_deref", f"""WITH {NEWEST} SELECT n.key, n.fid, n."offset", r.value, r.key IS NOT NULL AS found FROM newest n LEFT JOIN (SELECT * FROM records WHERE fid > 0) r ON r.fid = n.fid AND r."offset" = n."offset" """)
def _(s, d):
    records = _records(s, d)
    return valuelog.dereferenced(valuelog.index_of(records), records.filter("fid > 0"))


@query("kv_newest_pointer", f'WITH {RECORDS} SELECT fid, "offset", len FROM records ORDER BY fid DESC, "offset" DESC, len DESC LIMIT 1')
def _(s, d):
    return valuelog.newest_pointer(_records(s, d))


BAD = "seq % 1000 = 700 AND fid % 2 = 1"


@query("kv_wal_valid_prefix", f"WITH {RECORDS}, b AS (SELECT *, sum(CASE WHEN {BAD} THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY seq) AS bad FROM records) SELECT fid, \"offset\", key, seq FROM b WHERE bad = 0")
def _(s, d):
    return valuelog.valid_prefix(_records(s, d), F.expr(BAD)).select("fid", "offset", "key", "seq")


@query("kv_wal_valid_end", f"WITH {RECORDS} SELECT fid, CAST(coalesce(min(\"offset\") FILTER (WHERE {BAD}), sum(len)) AS BIGINT) AS valid_end, count(*) FILTER (WHERE {BAD}) > 0 AS cut FROM records GROUP BY fid")
def _(s, d):
    return valuelog.valid_ends(_records(s, d), F.expr(BAD))


@query("kv_discard_stats", f"WITH {ALIVE} SELECT fid, total, discard, round(discard / total, 6) AS ratio FROM discards")
def _(s, d):
    return valuelog.discard_stats(_records(s, d), NOW)


@query("kv_gc_pick", f"WITH {ALIVE} SELECT fid, total, discard, round(discard / total, 6) AS ratio FROM discards WHERE fid < (SELECT max(fid) FROM discards) ORDER BY discard DESC, fid LIMIT 1")
def _(s, d):
    head = table(s, d, "events").agg(F.floor(F.max("event_id") / FILE_ROWS).alias("head"))
    return valuelog.picked(valuelog.discard_stats(_records(s, d), NOW), head)


@query("kv_gc_ratio", f"WITH {ALIVE} SELECT fid, total, discard, round(discard / total, 6) AS ratio FROM discards WHERE discard >= 0.9 * total ORDER BY discard DESC, fid")
def _(s, d):
    return valuelog.collectable(valuelog.discard_stats(_records(s, d), NOW), 0.9)


@query("kv_gc_survivors", f'WITH {ALIVE} SELECT {ALL}, fid, "offset" FROM alive WHERE alive AND fid IN (SELECT fid FROM discards WHERE discard >= 0.9 * total)')
def _(s, d):
    judged = written(valuelog.with_liveness(_records(s, d), NOW))
    return valuelog.survivors(judged, valuelog.collectable(valuelog.dead_bytes(judged), 0.9))


@query("kv_gc_log_after", f"""WITH {ALIVE}, gone AS (SELECT fid FROM discards WHERE discard >= 0.9 * total),
n AS (SELECT n.*, op <> 'DEL' AND (ttl = 0 OR ttl > {NOW}) AS ok, key IN (SELECT key FROM records WHERE fid NOT IN (SELECT fid FROM gone)) AS hides FROM newest n WHERE fid IN (SELECT fid FROM gone))
SELECT {ALL}, fid FROM records WHERE fid NOT IN (SELECT fid FROM gone) UNION ALL SELECT key, CASE WHEN ok THEN value END AS value, op, ttl, version, seq, fid FROM n WHERE ok OR hides""")
def _(s, d):
    records = _records(s, d)
    gone = written(valuelog.collectable(valuelog.discard_stats(records, NOW), 0.9).select("fid"))
    cols = [*ALL.split(", "), "fid"]
    return records.join(gone, "fid", "left_anti").select(*cols).unionByName(valuelog.rewritten(records, gone, NOW).select(*cols))


@query("kv_recovered", f"""WITH {RECORDS}, b AS (SELECT *, sum(CASE WHEN seq % 1000 = 700 AND fid % 2 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY fid ORDER BY seq) AS bad FROM records),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC, seq DESC) AS rn FROM b WHERE bad = 0)
SELECT {ALL} FROM n WHERE rn = 1 AND op <> 'DEL' AND (ttl = 0 OR ttl > {NOW})""")
def _(s, d):
    return valuelog.recovered(_records(s, d), F.expr(BAD), NOW).select(*ALL.split(", "))


@query("kv_idle_files", f"WITH {ALIVE} SELECT fid FROM discards WHERE fid NOT IN (SELECT fid FROM discards WHERE discard >= 0.9 * total)")
def _(s, d):
    stats = written(valuelog.discard_stats(_records(s, d), NOW))
    return valuelog.idle_files(stats.select("fid"), valuelog.collectable(stats, 0.9))


@query("kv_discard_reloaded", f"WITH {ALIVE} SELECT fid, discard FROM discards")
def _(s, d):
    return valuelog.from_discard_json(valuelog.discard_json(valuelog.discard_stats(_records(s, d), NOW)))


@query("kv_discard_json", f"""WITH {ALIVE} SELECT fid // 1000 AS shard, '{{' || string_agg('"' || fid || '":' || discard, ',' ORDER BY CAST(fid AS VARCHAR)) || '}}' AS discards FROM discards GROUP BY 1""")
def _(s, d):
    return valuelog.discard_json(valuelog.discard_stats(_records(s, d), NOW))


@query("kv_table_stats", f"WITH {TABLES} SELECT table_id, min_key, max_key, key_count, max_version, size, stale_size FROM tab")
def _(s, d):
    return _tables(s, d).drop("level", "in_flight")


@query("kv_level_stats", f"WITH {TABLES} SELECT * FROM levels")
def _(s, d):
    return tables.level_stats(_tables(s, d))


@query("kv_level_order", f"WITH {TABLES} SELECT table_id, level, row_number() OVER (PARTITION BY level ORDER BY CASE WHEN level = 0 THEN table_id ELSE 0 END, min_key, table_id) AS place FROM tabs")
def _(s, d):
    place = F.row_number().over(W.partitionBy("level").orderBy(F.when(F.col("level") == 0, F.col("table_id")).otherwise(0), "min_key", "table_id"))
    return _tables(s, d).select("table_id", "level", place.alias("place"))


@query("kv_level_ranges", f"WITH {TABLES} SELECT level, min(min_key) AS lo, max(max_key) AS hi FROM tabs GROUP BY level")
def _(s, d):
    return tables.key_range(_tables(s, d))


@query("kv_table_overlap", f"WITH {TABLES} SELECT a.table_id, a.level, b.table_id AS below_id FROM tabs a JOIN tabs b ON b.level = a.level + 1 AND a.min_key <= b.max_key AND a.max_key >= b.min_key")
def _(s, d):
    return tables.overlapping(_tables(s, d))


@query("kv_table_for_key", f"WITH {TABLES}, k AS (SELECT DISTINCT key FROM kv) SELECT k.key, t.table_id, t.level FROM k JOIN tabs t ON k.key BETWEEN t.min_key AND t.max_key")
def _(s, d):
    return tables.tables_for_keys(_kv(s, d).select("key").distinct(), _tables(s, d))


@query("kv_plan_conflicts", f"""WITH {TABLES}, busy AS (SELECT level, min_key AS lo, max_key AS hi FROM tabs WHERE in_flight), plans AS (SELECT table_id AS plan_id, level, min_key AS lo, max_key AS hi FROM tabs WHERE NOT in_flight)
SELECT * FROM plans p WHERE EXISTS (SELECT 1 FROM busy b WHERE b.level = p.level AND p.lo <= b.hi AND p.hi >= b.lo)""")
def _(s, d):
    t = _tables(s, d).select(F.col("table_id").alias("plan_id"), "level", F.col("min_key").alias("lo"), F.col("max_key").alias("hi"), "in_flight")
    return tables.conflicting(t.filter("not in_flight").drop("in_flight"), t.filter("in_flight"))


#: Narrow tables: those of a level are disjoint, and levels are cut at different users.
NARROW = f"""{KV}, tab AS (
  SELECT (seq % 3) * 1000 + CAST(substr(key, 1, 5) AS BIGINT) // (20 + 5 * (seq % 3)) AS table_id, min(key) AS min_key, max(key) AS max_key, max(version) AS max_version FROM kv GROUP BY 1),
tabs AS (SELECT *, table_id // 1000 AS level, table_id % 7 = 3 AS in_flight FROM tab)"""


def _narrow(spark: SparkSession, folder: str) -> DataFrame:
    level = F.col("seq") % 3
    number = level * 1000 + F.floor(F.substring("key", 1, 5).cast("long") / (20 + 5 * level))
    out = tables.table_stats(_kv(spark, folder), number, NOW).withColumn("level", F.floor(F.col("table_id") / 1000))
    return out.withColumn("in_flight", F.col("table_id") % 7 == 3)


@query("kv_narrow_overlap", f"WITH {NARROW} SELECT a.table_id, a.level, b.table_id AS below_id FROM tabs a JOIN tabs b ON b.level = a.level + 1 AND a.min_key <= b.max_key AND a.max_key >= b.min_key")
def _(s, d):
    return tables.overlapping(_narrow(s, d))


@query("kv_narrow_for_key", f"WITH {NARROW}, k AS (SELECT DISTINCT key FROM kv) SELECT k.key, t.table_id, t.level FROM k JOIN tabs t ON k.key BETWEEN t.min_key AND t.max_key")
def _(s, d):
    return tables.tables_for_keys(_kv(s, d).select("key").distinct(), _narrow(s, d))


def _top(tabs: str, base: int) -> str:
    return f"""WITH {tabs}, t0 AS (SELECT *, min(min_key) OVER w AS lo, max(max_key) OVER w AS hi FROM tabs WHERE level = 0 AND NOT in_flight WINDOW w AS (ORDER BY max_version, table_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t1 AS (SELECT *, max(CASE WHEN min_key > hi OR max_key < lo THEN 1 ELSE 0 END) OVER (ORDER BY max_version, table_id) AS stopped FROM t0)
SELECT table_id, level, min_key, max_key, 'top' AS role FROM t1 WHERE stopped = 0
UNION ALL SELECT table_id, level, min_key, max_key, 'bottom' FROM tabs WHERE level = {base} AND min_key <= (SELECT max(max_key) FROM t1 WHERE stopped = 0) AND max_key >= (SELECT min(min_key) FROM t1 WHERE stopped = 0)"""


@query("kv_l0_to_base", _top(TABLES, 2))
def _(s, d):
    return tables.level_zero_to_base(_tables(s, d), 2)


@query("kv_l0_to_base_narrow", _top(NARROW, 1))
def _(s, d):
    return tables.level_zero_to_base(written(_narrow(s, d)), 1)


PLAN = f"""{NARROW}, busy AS (SELECT level, min_key AS lo, max_key AS hi FROM tabs WHERE in_flight),
p AS (SELECT a.table_id, a.max_version, a.min_key AS this_lo, a.max_key AS this_hi, count(b.table_id) AS n_bottom, coalesce(min(b.min_key), a.min_key) AS next_lo, coalesce(max(b.max_key), a.max_key) AS next_hi
  FROM tabs a LEFT JOIN tabs b ON b.level = 2 AND a.min_key <= b.max_key AND a.max_key >= b.min_key WHERE a.level = 1 GROUP BY a.table_id, a.max_version, a.min_key, a.max_key),
plan AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM busy b WHERE (b.level = 1 AND this_lo <= b.hi AND this_hi >= b.lo) OR (b.level = 2 AND next_lo <= b.hi AND next_hi >= b.lo)) ORDER BY max_version, table_id LIMIT 1)"""


def _busy(tabs: DataFrame) -> DataFrame:
    return tabs.filter("in_flight").select("level", F.col("min_key").alias("lo"), F.col("max_key").alias("hi"))


@query("kv_level_to_next", f"WITH {PLAN} SELECT * FROM plan")
def _(s, d):
    t = written(_narrow(s, d))
    return tables.level_to_next(t, 1, _busy(t))


@query("kv_reserved_ranges", f"WITH {PLAN} SELECT level, lo, hi FROM busy UNION ALL SELECT 1, this_lo, this_hi FROM plan UNION ALL SELECT 2, next_lo, next_hi FROM plan")
def _(s, d):
    t = written(_narrow(s, d))
    return tables.reserved(_busy(t), tables.level_to_next(t, 1, _busy(t)).withColumn("level", F.lit(1).cast("long")))


@query("kv_released_ranges", f"WITH {PLAN} SELECT level, lo, hi FROM busy")
def _(s, d):
    t = written(_narrow(s, d))
    plan = written(tables.level_to_next(t, 1, _busy(t)).withColumn("level", F.lit(1).cast("long")))
    return tables.released(tables.reserved(_busy(t), plan), plan)


@query("kv_compact_by_split", f"""WITH {LATEST}, {TABLES.split(', tab AS (', 1)[1].join(['tab AS (', ''])}, n AS (SELECT max_key, row_number() OVER (ORDER BY min_key, table_id) AS rn, count(*) OVER () AS n FROM tabs WHERE level = 6),
c AS (SELECT max_key FROM n WHERE (rn - 1) % greatest(3, CAST(ceil(n / 5) AS BIGINT)) = greatest(3, CAST(ceil(n / 5) AS BIGINT)) - 1 AND rn < n)
SELECT key, version, seq, (SELECT count(*) FROM (SELECT DISTINCT max_key FROM c) WHERE max_key < key) AS split FROM latest WHERE op <> 'DEL' AND (ttl = 0 OR ttl > {NOW})""")
def _(s, d):
    upper = tables.split_points(_tables(s, d).filter("level = 6")).filter("hi is not null").select("hi").distinct()
    return tables.split_of(tables.compacted(_kv(s, d), NOW), upper).select("key", "version", "seq", "split")


_S = [f"coalesce(sum(size) FILTER (WHERE level = {i}), 0) AS s{i}, coalesce(sum(in_flight_size) FILTER (WHERE level = {i}), 0) AS f{i}" for i in range(7)]
_GAP = "b1"
_STEPS = []
for _i in range(2, 6):
    _STEPS.append(f"g{_i} AS (SELECT * EXCLUDE (base), CASE WHEN base = {_i - 1} AND s{_i} = 0 THEN {_i} ELSE base END AS base FROM {_GAP})")
    _GAP = f"g{_i}"
PRIORITIES = f"""{TABLES}, one AS (SELECT {', '.join(_S)}, coalesce(sum(n_tables) FILTER (WHERE level = 0), 0) AS n0 FROM levels),
tg AS (SELECT *, {', '.join(f'greatest(CAST(floor(s6 / {10 ** (6 - i)}) AS BIGINT), 20000) AS t{i}' for i in range(1, 7))} FROM one),
b1 AS (SELECT *, greatest({', '.join(f'CASE WHEN t{i} <= 20000 THEN {i} ELSE 0 END' for i in range(1, 7))}) AS base FROM tg),
{', '.join(_STEPS)},
b2 AS (SELECT * EXCLUDE (base), CASE {' '.join(f'WHEN base = {i} AND s{i} = 0 AND s{i + 1} < t{i + 1} THEN {i + 1}' for i in range(1, 6))} ELSE base END AS base FROM {_GAP}),
sc AS (SELECT 0 AS level, NULL AS target, base, CAST(n0 AS DOUBLE) AS score FROM b2 {' '.join(f'UNION ALL SELECT {i}, t{i}, base, (s{i} - f{i}) / t{i} FROM b2' for i in range(1, 7))}),
pr AS (SELECT a.level, CAST(a.target AS BIGINT) AS target, a.base AS base_level, round(a.score, 6) AS score, round(CASE WHEN a.score >= 1 AND b.score IS NOT NULL THEN a.score / greatest(b.score, 0.01) ELSE a.score END, 6) AS adjusted
  FROM sc a LEFT JOIN sc b ON b.level = CASE WHEN a.level = 0 THEN a.base WHEN a.level >= a.base THEN a.level + 1 END)"""


@query("kv_level_targets", f"WITH {PRIORITIES} SELECT * FROM pr")
def _(s, d):
    return tables.compaction_priorities(tables.level_stats(_tables(s, d)), LEVELS)


@query("kv_file_targets", f"WITH {PRIORITIES} SELECT i AS level, CAST(CASE WHEN i = 0 THEN {LEVELS.memtable_bytes} ELSE 5000 * pow(2, greatest(i - base, 0)) END AS BIGINT) AS file_bytes FROM b1, (SELECT unnest(range(7)) AS i)")
def _(s, d):
    return tables.file_targets(tables.level_stats(_tables(s, d)), LEVELS)


@query("kv_compaction_priority", f"WITH {PRIORITIES} SELECT * FROM pr WHERE score >= 1 AND level < 6")
def _(s, d):
    return tables.compaction_order(tables.compaction_priorities(tables.level_stats(_tables(s, d)), LEVELS), LEVELS)


@query("kv_compaction_candidates", f"WITH {TABLES} SELECT table_id, stale_size, max_version FROM tabs WHERE level = 6 AND stale_size >= 5000 ORDER BY stale_size DESC, table_id")
def _(s, d):
    return tables.stale_candidates(_tables(s, d), 6, 5000)


@query("kv_level_zero_candidates", f"WITH {TABLES}, c AS (SELECT table_id, size, max_version FROM tabs WHERE level = 0 AND size < 50000 AND NOT in_flight) SELECT * FROM c WHERE (SELECT count(*) FROM c) >= 1")
def _(s, d):
    return tables.level_zero_candidates(_tables(s, d), 25_000, least=1)


@query("kv_compaction_splits", f"""WITH {TABLES}, n AS (SELECT *, row_number() OVER (ORDER BY min_key, table_id) AS rn, count(*) OVER () AS n FROM tabs WHERE level = 6),
c AS (SELECT rn, max_key, CASE WHEN rn = n THEN NULL ELSE max_key END AS hi FROM n WHERE (rn - 1) % greatest(3, CAST(ceil(n / 5) AS BIGINT)) = greatest(3, CAST(ceil(n / 5) AS BIGINT)) - 1 OR rn = n)
SELECT row_number() OVER (ORDER BY rn) - 1 AS split, lag(max_key) OVER (ORDER BY rn) AS lo, hi FROM c""")
def _(s, d):
    return tables.split_points(_tables(s, d).filter("level = 6"))


@query("kv_compact_result", f"WITH {LATEST} SELECT {ALL} FROM latest WHERE op <> 'DEL' AND (ttl = 0 OR ttl > {NOW})")
def _(s, d):
    return tables.compacted(_kv(s, d), NOW)


@query("kv_manifest_state", f"WITH {CHANGES} SELECT table_id, level FROM state")
def _(s, d):
    return manifest.state(_changes(s, d))


@query("kv_manifest_validate", f"""WITH {CHANGES}, b AS (SELECT *, lag(op) OVER (PARTITION BY table_id ORDER BY set_seq, pos) AS before FROM changes)
SELECT set_seq, pos, table_id, op, CASE WHEN op = 'CREATE' THEN 'created twice' ELSE 'deleted, not there' END AS fault FROM b WHERE (op = 'CREATE' AND before = 'CREATE') OR (op = 'DELETE' AND coalesce(before, 'DELETE') = 'DELETE')""")
def _(s, d):
    return manifest.faults(_changes(s, d))


@query("kv_manifest_reconcile", f"""WITH {CHANGES}, files AS (SELECT s_suppkey AS table_id FROM supplier)
SELECT table_id, 'missing' AS action FROM state WHERE table_id NOT IN (SELECT table_id FROM files) UNION ALL SELECT table_id, 'remove' FROM files WHERE table_id NOT IN (SELECT table_id FROM state)""")
def _(s, d):
    return manifest.reconciled(manifest.state(_changes(s, d)), table(s, d, "supplier").select(F.col("s_suppkey").alias("table_id")))


@query("kv_manifest_rewrite_flag", f"WITH {CHANGES}, n AS (SELECT count(*) FILTER (WHERE op = 'CREATE') AS creations, count(*) FILTER (WHERE op = 'DELETE') AS deletions FROM changes) SELECT *, deletions > 100 AND deletions > 0.1 * (creations - deletions) AS rewrite FROM n")
def _(s, d):
    return manifest.rewrite_due(_changes(s, d), 100, 0.1)


@query("kv_manifest_snapshot", f"WITH {CHANGES} SELECT 0 AS set_seq, table_id AS pos, table_id, 'CREATE' AS op, level FROM state")
def _(s, d):
    return manifest.snapshot(_changes(s, d))


@query("kv_replace_tables", f"""WITH {TABLES}, new AS (SELECT table_id + 100000 AS table_id, 5 AS level, size FROM tabs WHERE level = 4)
SELECT table_id, level, size FROM tabs WHERE table_id NOT IN (SELECT table_id FROM tabs WHERE level = 4) UNION ALL SELECT table_id, level, size FROM new""")
def _(s, d):
    t = _tables(s, d).select("table_id", F.col("level").cast("long").alias("level"), "size")
    gone = t.filter("level = 4")
    return manifest.replaced(t, gone, gone.select((F.col("table_id") + 100000).alias("table_id"), F.lit(5).cast("long").alias("level"), "size"))


@query("kv_commit_changes", f"""WITH {TABLES}, c AS (SELECT 0 AS rank, table_id + 100000 AS table_id, 'CREATE' AS op, 5 AS level FROM tabs WHERE level = 4 UNION ALL SELECT 1, table_id, 'DELETE', level FROM tabs WHERE level = 4)
SELECT 9 AS set_seq, row_number() OVER (ORDER BY rank, table_id) AS pos, table_id, op, level FROM c""")
def _(s, d):
    gone = _tables(s, d).filter("level = 4").select("table_id", F.col("level").cast("long").alias("level"))
    return manifest.change_set(gone, gone.select((F.col("table_id") + 100000).alias("table_id"), F.lit(5).cast("long").alias("level")), 9)


@query("kv_varint_size", f"SELECT event_id, {_uv('event_id * event_id * 1000')} AS bytes FROM events")
def _(s, d):
    i = F.col("event_id")
    return table(s, d, "events").select("event_id", sizes.varint_size(i * i * 1000).alias("bytes"))


@query("kv_entry_size", f"WITH {KV} SELECT seq, {RECORD} AS log_bytes, strlen(value) + 1 + {_uv('ttl')} AS value_bytes, strlen(key) + 8 + strlen(value) + 8 + 4 + 21 AS estimate FROM kv")
def _(s, d):
    k, v, t = F.col("key"), F.col("value"), F.col("ttl")
    return _kv(s, d).select("seq", sizes.wal_size(k, v, t).alias("log_bytes"), sizes.stored_value_size(v, t).cast("long").alias("value_bytes"), sizes.wal_estimate(k, v).alias("estimate"))


@query("kv_stored_key", f"WITH {KV} SELECT seq, hex(encode(key)) || hex(CAST(18446744073709551615 - CAST(version AS HUGEINT) AS UBIGINT)) AS stored, key AS parsed, version AS parsed_version FROM kv")
def _(s, d):
    stored = _kv(s, d).select("seq", sizes.with_suffix(F.col("key"), F.col("version")).alias("stored"))
    return stored.withColumns({"parsed": sizes.parsed_key(F.col("stored")), "parsed_version": sizes.parsed_version(F.col("stored"))})


@query("kv_file_names", "SELECT event_id, printf('%05d.sst', event_id) AS name, event_id AS parsed FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", sizes.file_name(F.col("event_id"), "sst").alias("name")).withColumn("parsed", sizes.file_id(F.col("name")))


@query("kv_next_power", "SELECT event_id, CASE WHEN event_id <= 1 THEN 1 ELSE CAST(pow(2, length(bin(event_id - 1))) AS BIGINT) END AS power FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", sizes.next_power_of_two(F.col("event_id")).alias("power"))


@query("kv_common_prefix", f"""WITH {KV}, f AS (SELECT seq // {TABLE_ROWS} AS table_id, key, seq, min(key) OVER (PARTITION BY seq // {TABLE_ROWS}) AS base FROM kv)
SELECT table_id, seq, base, coalesce(list_position(list_transform(range(1, least(length(key), length(base)) + 1), lambda i: key[i] = base[i]), false) - 1, least(length(key), length(base))) AS shared FROM f""")
def _(s, d):
    kv = _kv(s, d).withColumn("table_id", F.floor(F.col("seq") / TABLE_ROWS))
    base = kv.groupBy("table_id").agg(F.min("key").alias("base"))
    return kv.join(base, "table_id").select("table_id", "seq", "base", sizes.common_prefix(F.col("key"), F.col("base")).alias("shared"))


_CUT = """WITH RECURSIVE {kv}, r AS (SELECT seq // {rows} AS shard, seq, {size} AS size, row_number() OVER (PARTITION BY seq // {rows} ORDER BY seq) AS rn FROM kv),
c AS (SELECT shard, seq, size, rn, 0 AS piece, size AS total, 1 AS n FROM r WHERE rn = 1
  UNION ALL SELECT r.shard, r.seq, r.size, r.rn, CASE WHEN {full} THEN piece + 1 ELSE piece END, CASE WHEN {full} THEN r.size ELSE total + r.size END, CASE WHEN {full} THEN 1 ELSE n + 1 END FROM c JOIN r ON r.shard = c.shard AND r.rn = c.rn + 1)
SELECT shard, seq, size, piece FROM c"""


@query("kv_memtable_rotation", _CUT.format(kv=KV, rows=FILE_ROWS, size="strlen(key) + 8 + strlen(value) + 33", full=f"total + r.size > {MEMTABLE_BYTES}"))
def _(s, d):
    rows = _kv(s, d).select(F.floor(F.col("seq") / FILE_ROWS).alias("shard"), "seq", sizes.wal_estimate(F.col("key"), F.col("value")).alias("size"))
    return cutting.cut(rows, "shard", ["seq"], "size", MEMTABLE_BYTES)


@query("kv_vlog_rotation", _CUT.format(kv=KV, rows=FILE_ROWS, size=RECORD, full=f"(total > {LOG_BYTES} OR n >= {LOG_ROWS})"))
def _(s, d):
    rows = _kv(s, d).select(F.floor(F.col("seq") / FILE_ROWS).alias("shard"), "seq", sizes.value_log_size(F.col("key"), F.col("value"), F.col("ttl")).alias("size"))
    return cutting.cut(rows, "shard", ["seq"], "size", LOG_BYTES, LOG_ROWS, before=False)


_NEW = f"(c.\"end\" + 6 + k + r.v + r.t + 1 + 4 * (n + 1) + 16 > {BLOCK_BYTES})"
_SHARED = "coalesce(list_position(list_transform(range(1, least(length(r.key), length(c.base)) + 1), lambda i: r.key[i] = c.base[i]), false) - 1, least(length(r.key), length(c.base)))"


@query("kv_block_stats", f"""WITH RECURSIVE {KV}, r AS (SELECT seq // {TABLE_ROWS} AS table_id, key, strlen(value) AS v, {_uv('ttl')} AS t, strlen(key) + 8 AS k, row_number() OVER (PARTITION BY seq // {TABLE_ROWS} ORDER BY key, seq) AS rn FROM kv),
c AS (SELECT table_id, rn, key, 0 AS block, 1 AS n, 4 + k + v + 1 + t AS "end", key AS base, 4 + k + v + 1 + t AS added FROM r WHERE rn = 1
  UNION ALL SELECT r.table_id, r.rn, r.key, CASE WHEN {_NEW} THEN block + 1 ELSE block END, CASE WHEN {_NEW} THEN 1 ELSE n + 1 END,
    CASE WHEN {_NEW} THEN 4 + r.k + r.v + 1 + r.t ELSE c."end" + 4 + r.k - {_SHARED} + r.v + 1 + r.t END, CASE WHEN {_NEW} THEN r.key ELSE base END, CASE WHEN {_NEW} THEN 4 + r.k + r.v + 1 + r.t ELSE 4 + r.k - {_SHARED} + r.v + 1 + r.t END
  FROM c JOIN r ON r.table_id = c.table_id AND r.rn = c.rn + 1)
SELECT table_id, block, count(*) AS n_rows, CAST(sum(added) + 4 * count(*) + 16 AS BIGINT) AS n_bytes, min(key) AS first_key FROM c GROUP BY table_id, block""")
def _(s, d):
    rows = _kv(s, d).select(F.floor(F.col("seq") / TABLE_ROWS).alias("table_id"), "key", "seq", F.octet_length("value").cast("long").alias("value_bytes"), sizes.varint_size(F.col("ttl")).alias("ttl_bytes"))
    return cutting.blocks(rows, "table_id", BLOCK_BYTES)


@query("kv_frequency_capped", f"WITH {KV}, f AS (SELECT key, count(*) AS n, least(count(*), 15) AS counter FROM kv GROUP BY key) SELECT *, counter // 2 AS halved FROM f")
def _(s, d):
    return sketches.capped_frequency(_kv(s, d))


@query("kv_count_min", f"WITH {KV} SELECT count(DISTINCT key) AS n_keys, 0 AS too_low, 0 AS far_too_high, count(*) AS counted FROM kv")
def _(s, d):
    kv, cells = _kv(s, d), 1 << 16
    n, sketch = kv.groupBy("key").agg(F.count("*").alias("n")), sketches.count_min(kv, counters=cells)
    both = n.join(sketches.estimated(n.select("key"), sketch, counters=cells), "key").crossJoin(F.broadcast(sketch.filter("row = 0").agg(F.sum("n").alias("counted"))))  # the right side is one row
    far = F.col("estimate") > F.col("n") + F.greatest(F.lit(3), 8 * F.col("counted") / cells)
    return both.agg(F.count("*").alias("n_keys"), F.count(F.when(F.col("estimate") < F.col("n"), 1)).alias("too_low"), F.count(F.when(far, 1)).alias("far_too_high"), F.max("counted").alias("counted"))


# The hash, the checksum and the filter's bits in SQL, over the bytes of a text.
BYTES = "list_transform(range(0, strlen({x})), lambda i: CAST(('0x' || substr(hex(encode({x})), 2 * i + 1, 2)) AS HUGEINT))"
HASH = f"""{KV}, k AS (SELECT DISTINCT key FROM kv), b AS (SELECT key, strlen(key) AS n, {BYTES.format(x='key')} AS b FROM k),
w AS (SELECT key, n, b, list_transform(range(0, n // 4), lambda j: b[4 * j + 1] + b[4 * j + 2] * 256 + b[4 * j + 3] * 65536 + b[4 * j + 4] * 16777216) AS w FROM b),
h0 AS (SELECT key, n, b, list_reduce(list_prepend(xor({sketches.SEED}::HUGEINT, (n * {sketches.MULTIPLIER}::HUGEINT) % 4294967296), w), lambda h, x: xor(((h + x) * {sketches.MULTIPLIER}) % 4294967296, (((h + x) * {sketches.MULTIPLIER}) % 4294967296) >> 16)) AS h FROM w),
h1 AS (SELECT key, n % 4 AS r, h, h + list_sum(list_transform(range(0, n % 4), lambda j: b[4 * (n // 4) + j + 1] * CAST(pow(256, j) AS HUGEINT))) AS t FROM h0),
hashed AS (SELECT key, CAST(CASE WHEN r = 0 THEN h ELSE xor((CAST(t AS HUGEINT) * {sketches.MULTIPLIER}) % 4294967296, ((CAST(t AS HUGEINT) * {sketches.MULTIPLIER}) % 4294967296) >> 24) END AS BIGINT) AS h FROM h1)"""
FILTER = f"""{HASH}, even AS (SELECT * FROM hashed WHERE CAST(substr(key, 1, 5) AS BIGINT) % 2 = 0),
shape AS (SELECT (greatest(64, count(*) * 10) + 7) // 8 * 8 AS bits FROM even),
probed AS (SELECT key, unnest(list_transform(range(0, 6), lambda j: ((h + j * ((h * 32768) % 4294967296 + h // 131072)) % 4294967296) % bits)) AS bit FROM hashed, shape),
on_ AS (SELECT DISTINCT bit FROM probed WHERE key IN (SELECT key FROM even)),
found AS (SELECT p.key, count(o.bit) = 6 AS maybe FROM probed p LEFT JOIN on_ o ON o.bit = p.bit GROUP BY p.key)"""
IS_EVEN = "CAST(substr(key, 1, 5) AS BIGINT) % 2 = 0"


def _filtered(spark: SparkSession, folder: str) -> tuple[DataFrame, Column]:
    keys = _kv(spark, folder).select("key").distinct()
    even = F.substring("key", 1, 5).cast("long") % 2 == 0
    words, bits, probes = sketches.bloom_bits(keys.filter(even), "key", keys.filter(even).count())
    return sketches.may_contain(keys, "key", words, bits, probes), even


@query("kv_bloom_membership", f"WITH {FILTER} SELECT count(*) FILTER (WHERE {IS_EVEN}) AS n_keys, count(*) FILTER (WHERE {IS_EVEN} AND NOT maybe) AS lost, count(*) FILTER (WHERE NOT {IS_EVEN} AND maybe) AS false_hits FROM found")
def _(s, d):
    found, even = _filtered(s, d)
    return found.agg(F.count(F.when(even, 1)).alias("n_keys"), F.count(F.when(even & ~F.col("maybe"), 1)).alias("lost"), F.count(F.when(~even & F.col("maybe"), 1)).alias("false_hits"))


@query("kv_bloom_probe", f"WITH {FILTER} SELECT key, maybe FROM found")
def _(s, d):
    return _filtered(s, d)[0]


@query("kv_hash", f"WITH {HASH} SELECT key, h AS hash FROM hashed")
def _(s, d):
    return _kv(s, d).select("key").distinct().withColumn("hash", sketches.key_hash("key"))


@query("kv_crc32c", f"""WITH {KV}, b AS (SELECT seq, {BYTES.format(x='value')} AS b FROM kv)
SELECT seq, CAST(xor(list_reduce(list_prepend(4294967295::HUGEINT, b), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a % 2) * {sketches.CASTAGNOLI}::HUGEINT))), 4294967295::HUGEINT) AS BIGINT) AS crc FROM b""")
def _(s, d):
    return _kv(s, d).select("seq", sketches.crc32c("value").alias("crc"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
