"""Line deduplication over levelled sorted runs of line hashes.

A run is a Parquet table of (h1, h2, n, keeper) sorted by hash: ``n`` documents hold the line and ``keeper`` is the
largest of them. Each new batch of documents is summed to one row per line and merge-anti-joined with the runs: a line
that a run already counts in ``min_docs`` documents, with a keeper that the batch does not exceed, needs nothing more,
and all other lines of the batch form a run of their own at level 0. Where a level has ``fanout`` runs they are merged
into one of the next level. Sums and maxima make the outcome independent of batches and their order; one table is cut
into batches by a hash of the identifier, of whatever type it is, so that each document is in one batch.

Lines found in more than ``HOT_DOCS`` documents are kept apart from the shuffle by which the others meet their count.

The key of a line is the line without ASCII blanks at both ends, A-Z lower-cased; 128 bits of hash stand for it.

Cases: null or empty text: one empty line. Lines shorter than ``min_chars`` always stay. Null identifiers count as one
document below all others. Rows that repeat an identifier count as one document and are told apart by a hash of their
text, so equal rows lose the same lines. Very long texts are cut into lines whole, in one row each. Empty table: no
rows. Other columns pass through, except those named like the ones added (n_lines, n_dropped); working columns carry
the prefix ``_ld``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, ascii_lower, scratch_path, work_table, writing

MAX_BROADCAST_BYTES = 32 << 20
#: A line of more documents than this is not shuffled to its count.
HOT_DOCS = 1_000


class LineRuns:
    """Runs by level in a folder of their own below the shared scratch folder."""

    def __init__(self, spark: SparkSession, *, min_docs: int = 3, fanout: int = 3) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = scratch_path(spark, "line-runs")
        self.levels: dict[int, list[str]] = defaultdict(list)
        self._made = 0

    def _store(self, run: DataFrame, level: int) -> None:
        path = f"{self.path}/level={level}/run={self._made}"
        self._made += 1
        with writing(self.spark):
            run.sortWithinPartitions("h1", "h2").write.parquet(path)
        self.levels[level].append(path)

    def runs(self) -> list[str]:
        return [p for level in sorted(self.levels) for p in self.levels[level]]

    def rows(self, paths: list[str], id_type: str) -> DataFrame:
        return self.spark.read.schema(f"h1 long, h2 long, n long, keeper {id_type}").parquet(*paths)

    @staticmethod
    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def add(self, lines: DataFrame, key: str) -> None:
        """``lines``: (key, h1, h2), repeats allowed."""
        id_type = lines.schema[key].dataType.simpleString()
        batch = lines.select("h1", "h2", key).distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("keeper"))
        if paths := self.runs():
            settled = self.rows(paths, id_type).filter(F.col("n") >= self.min_docs).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("keeper").alias("_keeper"))
            known = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")) & (F.col("keeper") <= F.col("_keeper"))
            batch = batch.join(settled.hint("merge"), known, "left_anti")
        self._store(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._store(self.merged(self.rows(self.levels[level], id_type)), level + 1)
            self.levels[level] = []
            level += 1

    def repeated(self, id_type: str) -> DataFrame:
        """(h1, h2, n, keeper) of lines in at least ``min_docs`` documents; n is at most how many those are."""
        return self.merged(self.rows(self.runs(), id_type)).filter(F.col("n") >= self.min_docs)


def line_hashes(df: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """(_ld_key, _ld_hash, pos, h1, h2) of the lines whose key has at least ``min_chars`` code points."""
    lines = df.select(F.col(key).alias("_ld_key"), F.xxhash64(text).alias("_ld_hash"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("line", ascii_lower(F.btrim("line", F.lit(BLANKS)))).filter(F.length("line") >= min_chars)
    return keyed.select("_ld_key", "_ld_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def _at_repeats(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """``lines`` that are among ``repeated``, with the keeper; hot lines meet it in a broadcast, if that is small."""
    found = work_table(repeated.withColumnsRenamed({"h1": "_h1", "h2": "_h2"}), "repeated-lines")
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    hot = found.filter(F.col("n") > HOT_DOCS)
    if not 0 < hot.count() * 64 <= MAX_BROADCAST_BYTES:
        return lines.join(found, same)
    others = lines.join(F.broadcast(hot), same, "left_anti").join(found.filter(F.col("n") <= HOT_DOCS), same)
    return lines.join(F.broadcast(hot), same).unionByName(others)


def dedup_lines(df: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``df`` with ``text`` less its repeated lines, n_lines (before) and n_dropped."""
    spark = df.sparkSession
    path = scratch_path(spark, "line-hashes")
    hashed = line_hashes(df, key, text, min_chars)
    hashed.withColumn("batch", F.pmod(F.xxhash64("_ld_key"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashed.schema) + ", batch int").parquet(path)

    runs = LineRuns(spark, min_docs=min_docs, fanout=fanout)
    for i in range(batches):
        runs.add(lines.filter(F.col("batch") == i), "_ld_key")

    gone = _at_repeats(lines, runs.repeated(hashed.schema["_ld_key"].dataType.simpleString())).filter(~F.col("_ld_key").eqNullSafe(F.col("keeper")))
    dropped = work_table(gone.groupBy("_ld_key", "_ld_hash").agg(F.collect_set("pos").alias("_ld_dropped")), "dropped-lines")
    size = dropped.agg(F.sum(F.size("_ld_dropped") * 4 + 64)).first()[0] or 0
    same = F.col(key).eqNullSafe(F.col("_ld_key")) & (F.xxhash64(text) == F.col("_ld_hash"))
    marked = df.drop("n_lines", "n_dropped").join(F.broadcast(dropped) if size <= MAX_BROADCAST_BYTES else dropped, same, "left").drop("_ld_key", "_ld_hash")
    return _without_lines(marked, text)


def _without_lines(marked: DataFrame, text: str) -> DataFrame:
    columns = [c for c in marked.columns if c != "_ld_dropped"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema if f.name != "_ld_dropped"] + ["n_lines long", "n_dropped long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, lost = [], [], []
            for t, dropped in zip(batch.column(text).to_pylist(), batch.column("_ld_dropped").to_pylist()):
                lines = (t or "").split("\n")
                total.append(len(lines))
                lost.append(len(dropped or ()))
                if dropped:
                    out = set(dropped)
                    t = "\n".join(line for i, line in enumerate(lines) if i not in out)
                kept.append(t or "")
            arrays = [pa.array(kept, pa.string()) if c == text else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], [*columns, "n_lines", "n_dropped"])

    return marked.mapInArrow(run, schema)
