import pytest
from pyspark.sql import functions as F

from keylake import errors
from keylake.functions import sketches
from keylake.log import NOW, SCHEMA, Options, checked, kv_log
from keylake.operators import cutting, latest, manifest, ranges, reads, tables, writes
from keylake.plans import catalogue
from keylake.sources.files import numbered_files, table
from keylake.sources.store import Store
from keylake.streaming import running

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_query_equals_its_sql(name, same):
    same(catalogue.queries()[name], catalogue.oracle_sql()[name])


# Hashes of texts, and the filter of two words, least significant bit first.
HASHES = {"": 0xBC9F1D34, "g": 0xD04A8BDA, "go": 0x3E0B0745, "gop": 0x0C326610, "goph": 0x8C9D6390, "gophe": 0x9BFD4B0A, "gopher": 0xA78EDC7C, "I had a dream it would end this way.": 0xE14A9DB9}
FILTER = "1...1.........1.........1.....1...1...1.....1.........1.....1....11....."


def test_hash_vectors(spark):
    rows = spark.createDataFrame([(k,) for k in HASHES], "s string").select("s", sketches.key_hash("s").alias("h")).collect()
    assert {r.s: r.h for r in rows} == HASHES


def test_crc32c(spark):
    rows = spark.createDataFrame([("123456789",), ("",), (None,)], "s string").select("s", sketches.crc32c("s").alias("h")).collect()
    assert [r.h for r in rows] == [0xE3069283, 0, 0]


def test_small_filter(spark):
    keys = spark.createDataFrame([("hello",), ("world",)], "key string")
    words, bits, probes = sketches.bloom_bits(keys, "key", 2)
    on = {r.word * 32 + b for r in words.collect() for b in range(32) if r.mask >> b & 1}
    assert (bits, probes) == (64, 6)
    assert on == {i for i, c in enumerate(FILTER[:64]) if c == "1"}
    found = sketches.may_contain(spark.createDataFrame([("hello",), ("world",), ("x",), ("foo",)], "key string"), "key", words, bits, probes)
    assert {r.key: r.maybe for r in found.collect()} == {"hello": True, "world": True, "x": False, "foo": False}


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("key"))
    words, bits, probes = sketches.bloom_bits(keys, "key", 5000)
    other = spark.range(10**9, 10**9 + 10_000).select(F.col("id").cast("string").alias("key"))
    assert sketches.may_contain(keys, "key", words, bits, probes).filter("not maybe").count() == 0
    assert sketches.may_contain(other, "key", words, bits, probes).filter("maybe").count() <= 200


def test_store_put_get_delete_put_again(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.put([(f"key{i}", f"val{i}") for i in range(50)], ttl=NOW + 1000)
    assert s.get("key7", NOW) == "val7"
    s.delete([f"key{i}" for i in range(40)])
    s.delete(["hello"])
    with pytest.raises(errors.KeyNotFound):
        s.get("key7", NOW)
    s.put([(f"key{i}", f"new{i}") for i in range(10)], ttl=NOW + 1000)
    want = sorted([f"key{i}" for i in (*range(10), *range(40, 50))])
    assert [r.key for r in s.scan(now=NOW).collect()] == want
    assert [r.key for r in s.scan(prefix="key4", ascending=False, now=NOW).collect()] == sorted((k for k in want if k.startswith("key4")), reverse=True)
    s.compact(NOW)
    again = Store(spark, f"file://{tmp_path}/store")
    assert [r.key for r in again.scan(now=NOW).collect()] == want
    assert again.get("key3", NOW) == "new3" and again.info(NOW).first().n_rows == 20
    assert again.scan(now=NOW + 2000).count() == 0


def test_store_garbage_collection_frees_bytes_and_changes_no_read(spark, tmp_path):
    folder = tmp_path / "store"
    s = Store(spark, f"file://{folder}")
    rows = lambda turn, ids: spark.createDataFrame([(f"k{i:05d}", f"{turn}-{i}-" + "x" * 50) for i in ids], "key string, value string")
    for part in range(3):  # 27,000 keys, of which 9,000 in each batch, and 8,999 of two batches written again
        s.put(rows(0, range(part * 9000, part * 9000 + 9000)))
    for part in range(2):
        s.put(rows(1, range(part * 9000 + 1, part * 9000 + 9000, 3)))
        s.put(rows(2, range(part * 9000 + 2, part * 9000 + 9000, 3)))
    s.delete(["k00000", "k26999"])
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    read = lambda: {r.key: r.value for r in s.scan(now=NOW).collect()}
    before, bytes_before = read(), size()
    assert len(before) == 26_998
    gone = {r.fid for r in s.collect_garbage(0.5, NOW).collect()}
    assert len(gone) >= 2 and read() == before and size() < bytes_before
    assert not [k for k in gone if (folder / f"gen-0/batch={k}").exists()]
    again = Store(spark, f"file://{folder}")
    assert {r.key: r.value for r in again.scan(now=NOW).collect()} == before
    again.put([("k00000", "back")])
    assert again.get("k00000", NOW) == "back"
    with pytest.raises(errors.NoRewrite):
        again.collect_garbage(0.99, NOW)
    with pytest.raises(errors.InvalidRequest):
        again.collect_garbage(1.0, NOW)


def test_collection_puts_back_more_rows_than_a_batch_may_have(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.put([(f"k{i:05d}", "x" * 40) for i in range(9_900)])
    s.put([(f"m{i:05d}", "y" * 40) for i in range(9_900)])
    s.delete([f"{c}{i:05d}" for c in "km" for i in range(0, 9_900, 11)])
    before = {r.key for r in s.scan(now=NOW).collect()}
    assert len(before) == 18_000
    s.collect_garbage(0.05, NOW)
    assert {r.key for r in s.scan(now=NOW).collect()} == before


def test_a_collected_tombstone_goes_on_hiding_older_rows(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.put([("a", "old"), *[(f"k{i}", "v") for i in range(20)]])
    s.delete(["a", "never there"])
    assert s.collect_garbage(0.9, NOW).count() == 1
    with pytest.raises(errors.KeyNotFound):
        s.get("a", NOW)
    assert s.log().filter("key = 'never there'").count() == 0


def test_gets_skip_files_by_parquet_bloom_filters(spark, tmp_path):
    log = spark.range(20_000).selectExpr("concat('key', id * 7919 % 20000) AS key", "'v' AS value", "'PUT' AS op", "0L AS ttl", "1L AS version", "id AS seq")
    tables.write_sorted(log, f"file://{tmp_path}/t", filters_for=20_000)
    import pyarrow.parquet as pq

    files = list((tmp_path / "t").glob("*.parquet"))
    plain = f"{tmp_path}/plain"
    tables.write_sorted(log, f"file://{plain}")
    grown = sum(f.stat().st_size for f in files) - sum(f.stat().st_size for f in (tmp_path / "plain").glob("*.parquet"))
    assert grown > 10_000 and sum(pq.ParquetFile(f).metadata.num_rows for f in files) == 20_000
    assert reads.get(spark.read.schema(SCHEMA).parquet(f"file://{tmp_path}/t"), "key77", NOW).count() == 1


def test_a_compaction_is_written_by_split_ranges(spark, tmp_path):
    log = kv_log(table(spark, SF, "events"))
    upper = spark.createDataFrame([(0, "00004/view"), (1, None)], "split long, hi string")
    tables.write_sorted(tables.compacted(log, NOW), f"file://{tmp_path}/c", max_rows=10, splits=upper)
    out = spark.read.parquet(f"file://{tmp_path}/c")
    ends = {r.split: (r.lo, r.hi, r.n) for r in out.groupBy("split").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).collect()}
    assert set(ends) == {0, 1} and ends[0][1] <= "00004/view" < ends[1][0]
    assert sorted(r.key for r in out.collect()) == sorted(r.key for r in latest.live_rows(log, NOW).collect())


def _has_no_loops(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_range_joins_equal_brute_force_without_loops(spark):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(3))
    points = [(word(), i) for i in range(300)] + [(None, 999)]
    spans = [(*sorted((word(), word())), i) for i in range(150)] + [("", "zzz", 150), (None, "b", 151), ("a", None, 152)]
    p, s = spark.createDataFrame(points, "at string, p long"), spark.createDataFrame(spans, "lo string, hi string, s long")
    got = ranges.stabbed(p, s, "at", "lo", "hi")
    _has_no_loops(got)
    want = {(i, j) for at, i in points for lo, hi, j in spans if None not in (at, lo, hi) and lo <= at <= hi}
    pairs = [(x.p, x.s) for x in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want)
    other = s.select(F.col("lo").alias("l2"), F.col("hi").alias("h2"), F.col("s").alias("t"))
    got = ranges.overlaps(s, other, "lo", "hi", "l2", "h2")
    _has_no_loops(got)
    pairs = [(x.s, x.t) for x in got.collect()]
    whole = [x for x in spans if None not in x]
    assert set(pairs) == {(i, j) for a, b, i in whole for c, d, j in whole if a <= d and b >= c} and len(pairs) == len(set(pairs))
    assert ranges.stabbed(p.limit(0), s, "at", "lo", "hi").count() == ranges.stabbed(p, s.limit(0), "at", "lo", "hi").count() == 0


def test_neighbours_of_more_probes_than_keys(spark):
    log = spark.createDataFrame([(f"k{i:04d}", "v", "PUT", 0, 1, i) for i in range(0, 1000, 3)], SCHEMA)
    probes = spark.createDataFrame([(f"k{i:04d}",) for i in range(1000)] + [(None,)], "probe string")
    got = {r.probe: (r.gt, r.ge, r.lt, r.le) for r in reads.neighbours(log, probes, NOW).collect()}
    key = lambda i: f"k{i:04d}" if 0 <= i <= 999 else None
    assert got == {f"k{i:04d}": (key(i // 3 * 3 + 3), key(-(-i // 3) * 3), key(-(-i // 3) * 3 - 3), key(i // 3 * 3)) for i in range(1000)}
    assert reads.neighbours(log.limit(0), ["a"], NOW).first().asDict() == {"probe": "a", "gt": None, "ge": None, "lt": None, "le": None}


def _reads_no_frame_anew(df):
    plan = df._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_neighbours_of_a_table_read_no_frame_anew_for_every_row(spark):
    log = spark.createDataFrame([(f"k{i:04d}", "v", "PUT", 0, 1, i) for i in range(10)], SCHEMA)
    _reads_no_frame_anew(reads.neighbours(log, spark.createDataFrame([("k0003",)], "probe string"), NOW))


def _largest_share(df):
    """The part of the rows that one task makes."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    return max(n) / sum(n)


def test_pairs_of_wide_ranges_are_dealt_over_tasks(spark):
    keys = spark.range(6000).select(F.format_string("k%05d", "id").alias("key"))
    wide = spark.range(40).select(F.col("id").alias("table_id"), (F.col("id") % 3).alias("level"), F.format_string("k%05d", "id").alias("min_key"), F.format_string("k%05d", 5999 - F.col("id")).alias("max_key"))
    got = tables.tables_for_keys(keys, wide)
    assert got.count() == sum(6000 - 2 * i for i in range(40)) and got.distinct().count() == got.count()
    assert _largest_share(got) < 0.5


def test_keys_of_a_few_narrow_tables_are_dealt_over_tasks(spark):
    keys = spark.range(6000).select(F.format_string("k%05d", "id").alias("key"))
    number = F.format_string("k%05d", F.col("id") * 500)
    narrow = spark.range(12).select(F.col("id").alias("table_id"), F.lit(0).alias("level"), number.alias("min_key"), F.format_string("k%05d", F.col("id") * 500 + 499).alias("max_key"))
    got = tables.tables_for_keys(keys, narrow)
    assert sorted((r.key, r.table_id) for r in got.collect()) == [(f"k{i:05d}", i // 500) for i in range(6000)]
    assert _largest_share(got) < 0.5


def test_key_ranges_of_narrow_tables_read_no_values(spark):
    plan = catalogue._narrow(spark, SF).select("table_id", "level", "min_key", "max_key")._jdf.queryExecution().executedPlan().toString()
    assert "user_id" in plan and "props" not in plan


def test_neighbours_of_a_list_read_no_frame_anew_for_every_row(spark):
    log = spark.createDataFrame([(f"k{i:04d}", "v", "PUT", 0, 1, i) for i in range(0, 900, 3)], SCHEMA)
    got = reads.neighbours(log, ["k0003", "k0898", "k0000"], NOW)
    _reads_no_frame_anew(got)
    assert sorted(tuple(r) for r in got.collect()) == [("k0000", "k0003", "k0000", None, "k0000"), ("k0003", "k0006", "k0003", "k0000", "k0003"), ("k0898", None, None, "k0897", "k0897")]


def test_probes_of_a_list_need_no_python_on_the_executors(spark, monkeypatch):
    monkeypatch.setattr(reads.ranges, "beside", lambda keys, probes: probes)
    log = spark.createDataFrame([("k", "v", "PUT", 0, 1, 0)], SCHEMA)
    for probes in (["b", "", None], []):
        got = reads.neighbours(log, probes, NOW)
        assert got.schema.simpleString() == "struct<probe:string>" and [r.probe for r in got.collect()] == probes
        assert "LocalTableScan" in got._jdf.queryExecution().executedPlan().toString()


def test_a_long_value_doesnt_widen_the_others():
    values = [b"x"] * 1000 + [b"y" * 100_000] + [b"zz"]
    assert sketches.hash_bytes(values)[:1].tolist() == sketches.hash_bytes([b"x"]).tolist() and sketches.crc32c_bytes(values)[-1] == sketches.crc32c_bytes([b"zz"])[0]


def test_bad_batches(spark):
    rows = spark.createDataFrame([(None, "x"), ("k", "y")], "key string, value string")
    with pytest.raises(errors.EmptyKey):
        checked(writes.puts(rows, 1))
    with pytest.raises(errors.TxnTooBig):
        checked(writes.puts(rows.filter("key = 'k'"), 1), Options(max_batch_count=1))


def test_scan_and_get_agree_and_compaction_changes_nothing(spark):
    log = kv_log(table(spark, SF, "events"))
    scan = reads.scan(log, NOW).collect()
    assert [r.key for r in scan] == sorted(r.key for r in scan)
    assert reads.get(log, scan[5].key, NOW).first() == scan[5]
    assert reads.scan(tables.compacted(log, NOW), NOW).collect() == scan
    assert reads.scan(tables.compacted(log), NOW).collect() == scan


def test_key_filter_reaches_the_scan(spark, tmp_path):
    kv_log(table(spark, SF, "events")).write.parquet(f"{tmp_path}/log")
    plan = reads.get(spark.read.parquet(f"{tmp_path}/log"), "00002/view", NOW)._jdf.queryExecution().toString()
    assert "EqualTo(key,00002/view)" in plan


def test_ties_nulls_and_empty_logs(spark):
    log = spark.createDataFrame([("a", "1", "PUT", 0, 5, 1), ("a", "2", "PUT", 0, 5, 2), ("b", None, "DEL", 0, 5, 1), ("c", None, "PUT", 0, 1, 1)], SCHEMA)
    assert {r.key: r.value for r in latest.live_rows(log, NOW).collect()} == {"a": "2", "c": None}
    assert reads.with_neighbours(log.limit(0), NOW).count() == 0
    assert reads.info(log.limit(0), NOW).first().n_rows == 0


def test_greedy_cuts():
    import numpy as np

    assert cutting.cut_by_size(np.array([5, 5, 5, 20, 1]), 10).tolist() == [0, 0, 1, 2, 3]
    assert cutting.cut_by_size(np.array([5, 6, 5]), 10, before=False).tolist() == [0, 0, 1]


def test_manifest_snapshot_keeps_the_state(spark):
    rows = spark.createDataFrame([(1, 0, 7, "CREATE", 0), (2, 0, 8, "CREATE", 1), (3, 0, 7, "DELETE", 0)], "set_seq long, pos long, table_id long, op string, level int")
    assert manifest.state(manifest.snapshot(rows)).collect() == manifest.state(rows).collect()
    assert manifest.faults(rows).count() == 0


def test_numbered_files(spark, tmp_path):
    for n in ("00001.sst", "00012.sst", "x.txt"):
        (tmp_path / n).write_bytes(b"abc")
    assert {(r.table_id, r.bytes) for r in numbered_files(spark, str(tmp_path)).collect()} == {(1, 3), (12, 3)}


def test_streams(spark, tmp_path):
    log = kv_log(table(spark, SF, "events"))
    log.repartition(3).write.parquet(f"{tmp_path}/in")
    running.append_batches(running.log_stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    got = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out")
    assert sorted(latest.live_rows(got.select(*log.columns), NOW).collect()) == sorted(latest.live_rows(log, NOW).collect())
    q = running.running_latest(running.log_stream(spark, f"{tmp_path}/in"), "100 days").writeStream.format("memory").queryName("running").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert latest.latest(spark.table("running")).count() == log.select("key").distinct().count()
