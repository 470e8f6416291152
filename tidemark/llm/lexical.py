"""Ranked lexical search by sort-based accumulation.

Every item of a stated query set ranks all documents. A document's score for an item is the sum, over the item's terms,
of a term weight times the impact of the term in the document, all in 64-bit integers.

1. The items' terms, dealt in blocks of a bounded number of (item, term) pairs, are an index from term to items. Most
   query sets are one block; each block is a pass of its own, so no part of the set is left out.
2. One scan reads every text once a block and keeps of each document its length and the counts of the block's terms.
   These postings are written to a work table.
3. From it come the number of documents, their length and each term's number of documents, over the whole table.
4. The postings are dealt by ranges of documents, one a task. Of a chunk, the (item, document, impact) arrays of all matched terms are
   concatenated, keys of item and document are packed in 32 bits and radix sorted by 16-bit digits, and the sums of equal
   keys are taken with ``np.add.reduceat``. A heap for each item keeps the best ``k`` so far; a sum that is below the
   worst of a full heap never reaches it.
5. The tasks' bests, ``k`` an item at most, are ranked for each item.

Cases: null, empty or wordless texts have no terms, do not count as documents and are never found; items without terms
find nothing; terms that an item repeats count as often as they stand there. Rows that repeat an identifier are
documents, or items, of their own. Equal scores are ranked by ascending identifier, null last. Very long texts are read
whole, in one row each; their terms are counted before they are matched with items. Empty tables: no rows. Only the
identifiers of the inputs are returned, so other columns never clash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import words_of, work_table

#: (item, term) pairs of a block; a block is held by the driver and by every Python worker.
BLOCK_PAIRS = 500_000
#: Items of a block; they are numbered in 16 bits.
BLOCK_ITEMS = 1 << 15
#: Impacts that are sorted at a time.
CHUNK = 1 << 20
#: Texts that are cut into words at a time.
TEXTS = 200

#: Bytes of words as they are, A-Z lower-cased, all others as spaces.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_POSTINGS = "doc_id {kind}, n long, terms array<int>, counts array<int>"


def term_bytes(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8; non-ASCII characters are parts of words."""
    return text.translate(_FOLD).split() if text else []


class Block:
    """The terms of some items: term number by its bytes, and for each term its items and how often each has it."""

    def __init__(self, rows: pa.Table) -> None:
        item_rows, self.item_of = np.unique(rows["item_row"].to_numpy(), return_inverse=True)
        self.item_rows = item_rows
        names, number = np.unique(np.array(rows["term"].to_pylist(), object), return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.item_of = self.item_of[order].astype(np.uint32)
        self.times = rows["times"].to_numpy()[order].astype(np.int64)
        self.start = np.searchsorted(number[order], np.arange(len(names) + 1))
        self.vocabulary = {t.encode(): i for i, t in enumerate(names)}


def item_pairs(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(item_row, item_id) and (item_row, term, times); every row of ``items`` is an item."""
    numbered = work_table(items.select(F.monotonically_increasing_id().alias("item_row"), F.col(item_id).alias("item_id"), F.col(text).alias("text")), "search-items")
    pairs = numbered.select("item_row", F.explode(words_of(F.col("text"))).alias("term")).groupBy("item_row", "term").agg(F.count(F.lit(1)).alias("times"))
    return numbered.select("item_row", "item_id"), work_table(pairs, "search-terms")


def blocks_of(pairs: DataFrame) -> Iterator[Block]:
    """``pairs`` (item_row, term, times) in blocks; an item is in one block."""
    n, n_items = pairs.agg(F.count(F.lit(1)), F.count_distinct("item_row")).first()
    n_blocks = max(math.ceil(n / BLOCK_PAIRS), math.ceil(n_items / BLOCK_ITEMS * 2))
    for i in range(n_blocks if n else 0):
        rows = pairs.filter(F.pmod(F.xxhash64("item_row"), F.lit(n_blocks)) == i).toArrow()
        if rows.num_rows:
            yield Block(rows)


def postings(docs: DataFrame, block: Block, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term; terms are numbers in ``block``, counted."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(block.vocabulary)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.value.get
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                words = [term_bytes(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
                n = np.array([len(w) for w in words], np.int64)
                terms = np.fromiter((x for w in words for x in map(find, w, repeat(-1))), np.int64, n.sum())
                doc = np.repeat(np.arange(len(words)), n)
                keys, counts = np.unique((doc << 32 | terms)[terms >= 0], return_counts=True)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(keys >> 32, minlength=len(words)))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys & 0xFFFFFFFF, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"]).filter(pa.array(n > 0))

    return docs.select(doc_id, text).mapInArrow(run, _POSTINGS.format(kind=kind))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts 32-bit keys, by their 16-bit digits; a digit that is in order already is left alone."""
    order = np.arange(len(keys))
    for shift in (0, 16):
        digit = (keys[order] >> shift).astype(np.uint16)
        if np.any(digit[1:] < digit[:-1]):
            order = order[np.argsort(digit, kind="stable")]  # numpy's stable sort of 16-bit integers is a radix sort
    return order


def accumulated(block: Block, doc: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, sum) of postings: arrays of documents below 2^16, term numbers and impacts."""
    reach = block.start[terms + 1] - block.start[terms]
    at = np.repeat(block.start[terms] - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
    keys = block.item_of[at] << np.uint32(16) | np.repeat(doc, reach).astype(np.uint32)
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[: len(keys)]
    sums = np.add.reduceat((np.repeat(impact, reach) * block.times[at])[order], starts) if len(keys) else np.empty(0, np.int64)
    return keys[starts] >> 16, keys[starts] & 0xFFFF, sums


def chunks(doc: np.ndarray, reach: np.ndarray, most: int) -> Iterator[slice]:
    """Postings in order of documents, in slices of whole documents of about ``most`` impacts and less than 2^16 documents."""
    firsts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))[: len(doc)]
    before = np.concatenate([[0], np.cumsum(reach)])
    i = 0
    while i < len(firsts):
        j = max(i + 1, min(int(np.searchsorted(before[firsts], before[firsts[i]] + most, "right")) - 1, int(np.searchsorted(doc[firsts], doc[firsts[i]] + (1 << 16)))))
        yield slice(firsts[i], firsts[j] if j < len(firsts) else len(doc))
        i = j


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The ``k`` best (score, identifier) of each item: highest score, then smallest identifier, null last."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.heaps, self.worst = k, [[] for _ in range(n_items)], np.ones(n_items, np.int64)

    def take(self, items: np.ndarray, ids: list, docs: np.ndarray, sums: np.ndarray) -> None:
        """Sums in order of items."""
        firsts = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))[: len(items)]
        for item, i, j in zip(items[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(items)], strict=True):
            if j - i > self.k:
                self.worst[item] = max(self.worst[item], np.partition(sums[i:j], -self.k)[-self.k])
        for x in np.flatnonzero(sums >= self.worst[items]).tolist():
            item, key = int(items[x]), ids[docs[x]]
            heap, entry = self.heaps[item], (int(sums[x]), key is not None, _Down(key), key)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.worst[item] = max(int(self.worst[item]), heap[0][0])


class _Down:
    """Compares the other way round, so that the smallest identifier is best."""

    __slots__ = ("key",)

    def __init__(self, key) -> None:
        self.key = key

    def __lt__(self, other: _Down) -> bool:
        return self.key is not None and other.key is not None and other.key < self.key

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Down) and self.key == other.key


def bests(held: DataFrame, block: Block, weights: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """(item_row, doc_id, score): of each task's documents the ``k`` best of each item, with scores above 0."""
    shared, most = held.sparkSession.sparkContext.broadcast((block, weights)), CHUNK
    kind, key_type = held.schema["doc_id"].dataType.simpleString(), to_arrow_type(held.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        best = Best(len(block.item_rows), k)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            lists = batch.column("terms")
            size = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(ids)), size)
            terms, counts = (c.flatten().to_numpy().astype(np.int64) for c in (lists, batch.column("counts")))
            m = 25 + 75 * batch.column("n").to_numpy() * n_docs // total
            impact = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * m[doc]))
            for part in chunks(doc, block.start[terms + 1] - block.start[terms], most):
                first = doc[part.start]
                items, docs, sums = accumulated(block, doc[part] - first, terms[part], impact[part])
                best.take(items, ids, docs + first, sums)
        rows = [(int(block.item_rows[i]), key, score) for i, heap in enumerate(best.heaps) for score, _, _, key in heap]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), key_type, pa.int64()), strict=True)], ["item_row", "doc_id", "score"])

    return held.mapInArrow(run, f"item_row long, doc_id {kind}, score long")


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each row of ``items``.

    Identifiers of documents are integers or strings.
    """
    names, pairs = item_pairs(items, item_id, text)
    found = None
    for i, block in enumerate(blocks_of(pairs)):
        held = work_table(postings(docs, block, doc_id, text), f"search-postings-{i}")
        n_docs, total = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(block.vocabulary), np.int64)
        held_by = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # a row a term of the block
        df[held_by["term"].to_numpy()] = held_by["count"].to_numpy()
        weights = np.array([term_weight(n_docs, int(x)) for x in df], np.int64)
        # Ranges of documents; rows that share an identifier are told apart by their terms.
        ranges = held.repartitionByRange("doc_id", F.xxhash64("n", "terms", "counts"))
        best = work_table(bests(ranges, block, weights, n_docs, max(total, 1), k), f"search-bests-{i}")
        found = best if found is None else found.unionByName(best)
    if found is None:
        kind = docs.schema[doc_id].dataType.simpleString()
        found = docs.sparkSession.createDataFrame([], f"item_row long, doc_id {kind}, score long")
    order = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(names, "item_row").select("item_id", "rank", "doc_id", "score")
