"""Importance resampling towards a target distribution of hashed n-grams.

Words and pairs of words are features, hashed to a fixed number of buckets. A bucket's gain is the log ratio of its share
in the target texts and in all texts; a document's weight is the mean gain of its features. Documents are drawn without
replacement by Gumbel keys: the highest scores, weight plus noise that depends on the identifier alone, are the draw.

1. Each task hands its texts to DuckDB in small batches. SQL cuts them into words, unnests these, joins each with the next
   one by a window, and groups the features by a registered zlib CRC function. The bucket counts of each document are
   written to Parquet by Spark, in the shared scratch folder, so that a lost executor costs no more than its own tasks.
2. Spark merges the counts of all documents and of all target texts by bucket. That table has as many rows as there are
   buckets, whatever the input, which bounds the gains that go back to the tasks.
3. Weights are taken from the stored counts. The documents long enough are dealt by ranges of (score, identifier), each
   range numbers its own, and the ranges' sizes are summed in order, so no task sorts more than its range.

Cases: null, empty or wordless texts have no features and weight 0. One word: one feature. Very long texts are read
whole, in one row each; their bucket counts are one row of at most ``buckets`` entries. Rows that repeat an identifier
get equal noise and are drawn one by one; equal scores go to the smaller identifier, null first. Without target texts all
gains follow from the formula with no target features. Empty table: no rows. Only the identifier of the input is returned,
so other columns never clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, LOWER, UPPER, bounded, work_table

#: Bytes of text that one SQL statement takes; a longer text is taken alone.
BATCH_BYTES = 2 << 20

_COUNTED = "{key}n_words long, n_features long, buckets array<int>, counts array<int>"

_SQL = f"""
with words as (
    select place_in_batch, unnest(w) word, generate_subscripts(w, 1) place
    from (select place_in_batch, list_filter(string_split_regex(translate(body, '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '') w from texts)),
runs as (select place_in_batch, word, lead(word) over (partition by place_in_batch order by place) following from words),
features as (
    select place_in_batch, feature, count(*) n
    from (select place_in_batch, word feature from runs union all select place_in_batch, word || ' ' || following from runs where following is not null)
    group by place_in_batch, feature),
hashed as (select feature, zlib_crc32(feature) % {{buckets}} bucket from (select distinct feature from features)),
counted as (select place_in_batch, bucket, sum(n) n from features join hashed using (feature) group by place_in_batch, bucket),
listed as (
    select place_in_batch, sum(n)::bigint n_features, list(bucket::int order by bucket) buckets, list(n::int order by bucket) counts from counted group by place_in_batch),
sized as (select place_in_batch, count(*) n_words from words group by place_in_batch)
select coalesce(n_words, 0) n_words, coalesce(n_features, 0) n_features, coalesce(buckets, []::int[]) buckets, coalesce(counts, []::int[]) counts
from texts left join listed using (place_in_batch) left join sized using (place_in_batch) order by place_in_batch"""


def crc32_of(texts: pa.ChunkedArray) -> pa.Array:
    """The unsigned CRC-32 of each string in UTF-8."""
    return pa.array([zlib.crc32(t) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of the text in its last column."""
    sizes = np.array([len(t or b"") for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()], np.int64)
    ends = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
    for i, j in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
        yield batch.slice(i, j - i)


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(n_words, n_features, buckets, counts) of every row of ``texts`` (body), or (key, body), in that order."""
    most = BATCH_BYTES
    schema = _COUNTED.format(key="".join(f"key {f.dataType.simpleString()}, " for f in texts.schema if f.name == "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "256MB"}) as db:
            db.create_function("zlib_crc32", crc32_of, ["VARCHAR"], "BIGINT", type="arrow")
            for batch in batches:
                for part in _slices(batch, most):
                    db.register("texts", pa.table([np.arange(part.num_rows), part.column("body")], ["place_in_batch", "body"]))
                    counted = db.sql(_SQL.format(buckets=buckets)).to_arrow_table().combine_chunks()
                    db.unregister("texts")
                    keys = part.drop_columns(["body"])
                    yield pa.RecordBatch.from_arrays([*keys.columns, *[c.combine_chunks() for c in counted.columns]], [*keys.schema.names, *counted.schema.names])

    return texts.mapInArrow(run, schema)


def merged_counts(counted: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, over all rows; a row a bucket comes to the driver."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    rows = pairs.groupBy("x.buckets").agg(F.sum(F.col("x.counts").cast("long")).alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["buckets"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target share to source share, for each bucket."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(t) + 1) * (s_all + buckets) / ((int(s) + 1) * (t_all + buckets)))) for s, t in zip(source, target, strict=True)], np.int64)


def _weights(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("buckets")
        products = gains[lists.flatten().to_numpy()] * batch.column("counts").flatten().to_numpy()
        sums = np.concatenate([[0], np.cumsum(products)])
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(batch.column("n_features").to_numpy(), 1)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_words"), batch.column("n_features"), pa.array(weight)], ["key", "n_words", "n_features", "weight"])


def gumbel_noise(key: Column, seed: int) -> Column:
    """floor(1000 g) of a standard Gumbel variable g that depends on ``seed`` and ``key`` alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows))], [*batch.schema.names, "place"])
        at += batch.num_rows


def ranks(scored: DataFrame, key: str) -> DataFrame:
    """(row_id, rank) of ``scored`` (row_id, score, key) from the highest score, ties to the smaller key; by ranges."""
    order = [F.desc("score"), F.asc(key), F.asc("row_id")]
    ranged = scored.repartitionByRange(*order).sortWithinPartitions(*order).select("row_id", F.spark_partition_id().alias("part"))
    placed = work_table(ranged.mapInArrow(_numbered, "row_id long, part int, place long"), "resampling-places")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(bounded(work_table(before, "resampling-ranges"), 16), "part").select("row_id", (F.col("before") + F.col("place") + 1).alias("rank"))


def resample(
    docs: DataFrame, targets: DataFrame, *, percent: int = 25, min_words: int = 20, buckets: int = 10_000, seed: int = 7, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_features, weight, score, rank) per row; rank is null for documents that are not drawn."""
    counted = work_table(bucket_counts(docs.select(F.col(key).alias("key"), F.col(text).alias("body")), buckets), "resampling-counts")
    target = work_table(bucket_counts(targets.select(F.col(text).alias("body")), buckets), "resampling-targets")
    shared = docs.sparkSession.sparkContext.broadcast(gains_of(merged_counts(counted, buckets), merged_counts(target, buckets)))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _weights(batches, shared.value)

    kind = docs.schema[key].dataType.simpleString()
    weights = counted.mapInArrow(weighed, f"key {kind}, n_words long, n_features long, weight long")
    scored = weights.withColumn("row_id", F.monotonically_increasing_id()).withColumn("score", F.col("weight") + gumbel_noise(F.col("key"), seed))
    scored = work_table(scored, "resampling-scores")
    long_enough = scored.filter(F.col("n_words") >= min_words)
    drawn = ranks(long_enough.select("row_id", "score", "key"), "key").filter(F.col("rank") <= percent * long_enough.count() // 100)
    out = scored.join(drawn, "row_id", "left")
    return out.select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
