"""A store of a key-value log in a folder: batches are appended as Parquet, and a full compaction writes a new folder.

The store is a thin surface over the operators. `now` is asked of the clock only if it isn't given. A folder
holds generations (gen-0, gen-1, ...), and each of them batches (batch=N); the greatest generation with a _DONE
marker counts, so that a compaction that fails half-way changes nothing. One writer at a time.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.errors import InvalidRequest, KeyNotFound, NoRewrite
from keylake.functions.sizes import value_log_size
from keylake.log import SCHEMA, Options, checked
from keylake.operators import latest, reads, tables, valuelog, writes
from keylake.storage import written


class Store:
    def __init__(self, spark: SparkSession, folder: str, options: Options | None = None):
        self.spark, self.folder, self.options = spark, folder.rstrip("/"), options or Options()
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.generation = max((n for n in self._numbers(self.folder, r"gen-(\d+)$") if self._fs.exists(self._path(f"{self.folder}/gen-{n}/_DONE"))), default=-1)
        if self.generation < 0:
            self._finish(0)
        self._batch = 1 + max(self._numbers(self._gen(), r"batch=(\d+)$"), default=-1)
        self.open = True

    def _gen(self, n: int | None = None) -> str:
        return f"{self.folder}/gen-{self.generation if n is None else n}"

    def _numbers(self, folder: str, pattern: str) -> list[int]:
        p = self._path(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return [int(m[1]) for x in names if (m := re.match(pattern, x))]

    def _finish(self, n: int) -> None:
        self._fs.mkdirs(self._path(self._gen(n)))
        self._fs.create(self._path(f"{self._gen(n)}/_DONE")).close()
        self.generation, self._batch = n, 1 + max(self._numbers(self._gen(n), r"batch=(\d+)$"), default=-1)

    def _now(self, now: int | None) -> int:
        return int(time.time()) if now is None else now

    def _replaced(self) -> set[int]:
        """Batches whose rows garbage collection has put elsewhere: one small file a collection."""
        marks = [self._path(f"{self._gen()}/replaced-{n}") for n in self._numbers(self._gen(), r"replaced-(\d+)$")]
        return {int(x) for m in marks for x in self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(m), "UTF-8").split()}

    def _rows(self) -> DataFrame:
        """All rows of this generation with their batch."""
        if not self.open:
            raise InvalidRequest("the store is closed")
        there = sorted(set(self._numbers(self._gen(), r"batch=(\d+)$")) - self._replaced())
        if not there:
            return self.spark.createDataFrame([], SCHEMA + ", batch long")
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        found = self.spark.read.schema(SCHEMA + ", batch long").option("basePath", self._gen()).parquet(*[f"{self._gen()}/batch={n}" for n in there])
        return found.select(*names, F.col("batch").cast("long").alias("batch"))

    def log(self) -> DataFrame:
        """All rows of this generation."""
        return self._rows().drop("batch")

    def append(self, batch: DataFrame) -> int:
        """A batch with the log's columns but version, which is the batch's number; of repeated keys in a batch the greatest seq counts. All or nothing is written."""
        number = self._batch
        rows = checked(batch, self.options).withColumn("version", F.lit(number).cast("long"))
        rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")]).write.mode("errorifexists").parquet(f"{self._gen()}/batch={number}")
        self._batch += 1
        return number

    def put(self, rows: DataFrame | Iterable[tuple], ttl: int = 0) -> int:
        """Rows of key and value; the last of equal keys in a list wins."""
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "key string, value string, seq long")
        seq = F.col("seq") if "seq" in rows.columns else None
        return self.append(writes.puts(rows, 0, seq, ttl))

    def delete(self, keys: DataFrame | Iterable[str]) -> int:
        if not isinstance(keys, DataFrame):
            keys = self.spark.createDataFrame([(k,) for k in keys], "key string")
        return self.append(writes.tombstones(keys, 0))

    def get(self, key: str, now: int | None = None) -> str:
        row = reads.get(self.log(), key, self._now(now)).first()
        if row is None:
            raise KeyNotFound(key)
        return row["value"]

    def multi_get(self, keys: DataFrame, now: int | None = None) -> DataFrame:
        return reads.multi_get(self.log(), keys, self._now(now))

    def scan(self, low: str | None = None, high: str | None = None, prefix: str | None = None, ascending: bool = True, now: int | None = None) -> DataFrame:
        rows = self.log() if prefix is None else self.log().filter(F.col("key").startswith(prefix))
        out = reads.range_scan(rows, low, high, self._now(now))
        return out if ascending else out.orderBy(F.col("key").desc())

    def info(self, now: int | None = None) -> DataFrame:
        return reads.info(self.log(), self._now(now))

    def compact(self, now: int | None = None) -> int:
        """Writes the live rows, in sorted files with Bloom filters on the key, as the next generation, and moves to it."""
        following = self.generation + 1
        tables.write_sorted(tables.compacted(self.log(), self._now(now)), f"{self._gen(following)}/batch={self._batch}", self.options.value_log_entries, filters_for=self.options.value_log_entries, mode="overwrite")
        self._finish(following)
        return following

    def collect_garbage(self, ratio: float | None = None, now: int | None = None) -> DataFrame:
        """Batches whose dead share of bytes is `ratio` or more go, and the rows of them that must stay are put in new batches with their versions; returns the batches (fid) that went.

        Rows in new batches first repeat old ones, which changes no read; the marker that names the old batches makes
        them unseen, all at once; then their files go. Only the collected batches are rewritten.
        """
        now = self._now(now)
        records = self._rows().withColumnRenamed("batch", "fid").withColumn("len", value_log_size(F.col("key"), F.col("value"), F.col("ttl")))
        records = records.withColumn("offset", F.col("seq"))  # tells a key's rows of one batch apart
        files = written(valuelog.collectable(valuelog.discard_stats(records, now), self.options.discard_ratio if ratio is None else ratio))
        if files.isEmpty():
            raise NoRewrite("no batch has so many dead bytes")
        rows = written(valuelog.rewritten(records, files, now))
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("bytes")).first()
        # Bounded batches, each within half the limits of a put.
        n = 1 + max(2 * size["n"] // self.options.max_batch_count, 2 * size["bytes"] // self.options.max_batch_bytes)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        out = rows.select(*names, (F.lit(self._batch) + F.pmod(F.xxhash64("key"), F.lit(n))).alias("batch"))
        out.repartition("batch").write.mode("append").partitionBy("batch").parquet(self._gen())
        self._batch += n
        gone = [r["fid"] for r in files.select("fid").collect()]  # one number a batch
        with_names = self._fs.create(self._path(f"{self._gen()}/replaced-{self._batch}"))
        with_names.writeBytes("\n".join(map(str, gone)))
        with_names.close()
        for k in gone:
            self._fs.delete(self._path(f"{self._gen()}/batch={k}"), True)
        return files

    def latest(self) -> DataFrame:
        return latest.latest(self.log())

    def close(self) -> None:
        self.open = False
