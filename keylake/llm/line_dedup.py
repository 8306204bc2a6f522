"""Removal of lines that many documents share, over levelled sorted runs of line hashes.

Every batch of documents is reduced to a run: one row per line key with the number of the batch's
documents that hold it, sorted by hash. Before that, the batch is merge-anti-joined with the runs: lines
whose keys enough documents of the runs hold are settled, and aren't counted again. Runs of a level are
merged, by sort-merge joins on the hash, into one run of the next level when `fanout` of them have gathered, so
a corpus that grows by batches rewrites each hash only log_fanout(batches) times. As a line is dropped from all
documents, those of earlier batches too, the texts are rebuilt after the last batch, by the same anti-join.

Defined cases: a null text is an empty one and has one empty line, which always stays; rows equal in
doc_id and text are the same document stored twice and count once; a null doc_id is an id like others;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keylake.llm.common import batch_of, shared_dir, stored, text_or_empty

KEY = ["h1", "h2"]


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip().lower()


def line_rows(documents: DataFrame, min_chars: int = 1, batches: int = 1) -> DataFrame:
    """One row per line whose key has min_chars code points or more: batch, doc_id, t (hash of the text), pos, h1, h2 (the key's 128-bit hash)."""

    def rows(it):
        for b in it:
            ids, ts, pos, h1, h2, counts = b.column("doc_id"), b.column("t"), [], [], [], []
            for text in b.column("text").to_pylist():
                before = len(pos)
                for i, line in enumerate(text.encode().split(b"\n")):
                    key = line_key(line)
                    if len(key) < min_chars or min_chars > 1 and len(key.decode()) < min_chars:
                        continue
                    d = xxhash.xxh3_128_digest(key)
                    pos.append(i)
                    h1.append(int.from_bytes(d[:8], "big", signed=True))
                    h2.append(int.from_bytes(d[8:], "big", signed=True))
                counts.append(len(pos) - before)
            at = pa.array([i for i, n in enumerate(counts) for _ in range(n)], pa.int32())
            t = ts.take(at)
            batch = [x % batches for x in t.to_pylist()]
            yield batch_of({"batch": (batch, pa.int32()), "doc_id": (ids.take(at), None), "t": (t, None), "pos": (pos, pa.int32()), "h1": (h1, pa.int64()), "h2": (h2, pa.int64())})

    source = identified(documents).drop("row")
    return source.mapInArrow(rows, "batch int, doc_id long, t long, pos int, h1 long, h2 long")


def identified(documents: DataFrame) -> DataFrame:
    """doc_id, text, t (a hash of the text), and `row`, a struct of the other columns."""
    text = text_or_empty()
    others = [F.col(f"`{c}`") for c in documents.columns if c.lower() != "text"]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"), F.struct(*others).alias("row"))


class LineRuns:
    """Levelled sorted runs of line keys with document counts, under one folder.

    runs: (level, name) of the runs that are there, oldest first; keep it to go on in a later session.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 3, runs: list[tuple[int, str]] | None = None):
        self.spark, self.path, self.fanout = spark, path or shared_dir(spark), fanout
        self.runs = list(runs or [])

    def _write(self, counts: DataFrame, level: int) -> None:
        name = f"level{level}-{uuid.uuid4().hex}"  # no name comes twice, however many sessions go on with the runs
        # The exchange of the grouping or merging leaves each key in one partition; sorting there makes each file a sorted run.
        counts.sortWithinPartitions(*KEY).write.mode("errorifexists").parquet(f"{self.path}/{name}")
        self.runs.append((level, name))

    def _read(self, runs: list[tuple[int, str]]) -> DataFrame:
        schema = "h1 long, h2 long, n long"
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}" for _, name in runs])

    def add(self, lines: DataFrame, min_docs: int | None = None) -> None:
        """A batch's lines (of line_rows) become a run, without those whose keys min_docs documents of the runs hold; full levels are compacted."""
        if min_docs is not None and self.runs:
            lines = self.unseen(lines, min_docs)
        once = lines.groupBy("doc_id", "t", *KEY).agg(F.lit(1).alias("one"))
        self._write(once.groupBy(*KEY).agg(F.count("*").alias("n")), 0)
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fanout:
            self._write(self._merged(full), level + 1)
            self.runs = [r for r in self.runs if r not in full]
            level += 1

    def _merged(self, runs: list[tuple[int, str]]) -> DataFrame:
        """Sorted runs merged one after the other; counts of equal keys are added."""
        out = self._read(runs[:1])
        for r in runs[1:]:
            more = self._read([r]).withColumnRenamed("n", "m")
            out = out.join(more.hint("merge"), KEY, "full_outer").select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def counts(self) -> DataFrame:
        """Documents per key over all runs."""
        return self._merged(self.runs)

    def frequent(self, min_docs: int) -> DataFrame:
        return self.counts().filter(F.col("n") >= min_docs).select(*KEY)

    def unseen(self, lines: DataFrame, min_docs: int = 1) -> DataFrame:
        """The batch's lines whose keys are in fewer than min_docs documents of the runs: a merge anti-join.

        The frequent keys are written first, so that both sides of the join are plain exchanges and
        Spark can split the partition of a hot line.
        """
        return lines.join(stored(self.frequent(min_docs)).hint("merge"), KEY, "left_anti")


def drop_shared_lines(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without lines whose key is in min_docs documents or more), row (the other columns).

    The lines' hashes are written once, by batch; each batch adds its run. Then all lines are
    anti-joined with the runs' frequent keys, and each text is rebuilt from the lines that stay.
    """
    spark = documents.sparkSession
    lines = stored(line_rows(documents, min_chars, batches), partition_by=["batch"])
    runs = LineRuns(spark, fanout=fanout)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b), min_docs)
    stay = runs.unseen(lines, min_docs).groupBy("doc_id", "t").agg(F.collect_set("pos").alias("stay"))
    d, k = identified(documents).alias("d"), stay.alias("k")
    joined = d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.t") == F.col("k.t")), "left").select("d.doc_id", "d.text", "k.stay", "d.row")

    def rebuild(it):
        for b in it:
            n_lines, n_dropped, kept = [], [], []
            for text, stay in zip(b.column("text").to_pylist(), b.column("stay").to_pylist(), strict=True):
                stay = set(stay or ())
                all_lines = text.split("\n")
                left = [x for i, x in enumerate(all_lines) if i in stay or _short(x, min_chars)]
                n_lines.append(len(all_lines))
                n_dropped.append(len(all_lines) - len(left))
                kept.append("\n".join(left))
            yield batch_of({"doc_id": (b.column("doc_id"), None), "n_lines": (n_lines, pa.int64()), "n_dropped": (n_dropped, pa.int64()), "kept": (kept, pa.string()), "row": (b.column("row"), None)})

    schema = T.StructType.fromDDL("doc_id long, n_lines long, n_dropped long, kept string").add(joined.schema["row"])
    return joined.mapInArrow(rebuild, schema)


def cleaned(documents: DataFrame, min_docs: int = 10) -> DataFrame:
    """The documents with all their columns; text without shared lines, and n_chars, where there is one, as it then is."""
    out = drop_shared_lines(documents, min_docs)
    now = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[now[c.lower()].alias(c) if c.lower() in now else F.col(f"row.`{c}`") for c in documents.columns])


def _short(line: str, min_chars: int) -> bool:
    key = line_key(line.encode())
    return len(key) < min_chars or len(key.decode()) < min_chars


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op9(spark: SparkSession, documents: DataFrame) -> DataFrame:
    return drop_shared_lines(documents.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY doc_id
"""
