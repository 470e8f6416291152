"""Exact n-gram Jaccard join with token-combination prefixes.

A document is the set of its hashed word shingles; documents of equal sets form one node. With similarity ``t`` a
linked pair of ``s`` shingles lacks at most ``floor((1 - t) s)`` of them on either side, so in any common order of
shingles the first ``floor((1 - t) s) + 1`` of both have one in common.

1. Every document lists its first shingles in hash order: as many as a prefix takes and a quarter more. They are
   counted over the corpus; those of more than ``FREQUENT`` nodes are the frequent class, all others are rare.
2. In the order of rare before frequent, the prefix of most documents is made of rare shingles of their list; these
   are indexed singly. Documents whose list has too few rare shingles, members of large groups of near copies mostly,
   are dense and are read again as a whole.
3. Of a linked pair with a document that is not dense, the prefix of that one is rare, so the pair shares a rare
   shingle of both prefixes. The prefix of a dense document may reach beyond its list; those shingles are looked up in
   the lists of the others.
4. For pairs of dense documents their shingles are counted again, over dense documents and whole sets, which gives a
   new frequent class. Rare shingles are indexed singly, frequent ones as pairs within subclasses, and the prefix is
   extended until its rare shingles and, for each subclass, its frequent ones but one add up to what a linked pair may
   lack plus one: then the pair has a rare shingle or a pair of frequent ones in common. The number of subclasses
   depends on a band of sizes; linked documents are in the same or in adjacent bands, so each document is indexed for
   its own band and the one below.

So every linked pair meets in some bucket of the index. No bucket is paired with itself as a whole:

5. A bucket names up to ``PIVOTS`` members its pivots and compares them with all its members, which is linear in the
   index. Pairs pass if sizes, 512-bit parity sketches and the lists allow the similarity: up to the end of the
   shorter list both are complete, and differ there in no more shingles than linked sets differ in as a whole. They are
   verified on the whole sets and linked documents are contracted to components. The pivots, having met all of their
   bucket, leave it; buckets left with one component are done.
6. What remains is the bucket's largest component and strays from other ones. Strays meet all members of other
   components; the sketches are compared within that join, and a pair is emitted at the first of the 64 smallest
   signatures of both that they share. Of pairs that pass, each document's nearest is verified first, then every one
   that is not yet in one component.

Components come from verified links alone. Only counts reach the driver. Copies never form pairs.

Cases: null or wordless text: empty set, linked with nothing. Texts shorter than a shingle: the whole sequence is one.
Very long texts: sets and signatures grow with the text, in one row each. Rows that repeat an identifier keep a row
each, and a component is named by the smallest identifier in it, ignoring nulls; rows without one are linked like any
other, and a component of such rows alone has no name. Empty table: no rows. Only the identifier of the input is returned, so other columns never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tidemark.llm.common import bounded, work_table
from tidemark.llm.components import connected

#: A shingle of more nodes than this is frequent.
FREQUENT = 32
#: Members of a bucket that meet all others before strays do.
PIVOTS = 4
#: Smallest signatures of a document that tell where a pair is emitted.
LOWEST = 64
SKETCH = [f"k{i}" for i in range(8)]

_P = np.uint64(0x9E3779B97F4A7C15)


#: Texts that a Python worker holds at a time.
TEXTS = 200


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


class _Words(dict):
    """Hashes of words, forgotten when there are very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int, words: _Words) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order."""
    found = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII blanks only
    if not found:
        return np.empty(0, np.uint64)
    w = np.array([words[x] for x in found], np.uint64)
    size = min(k, len(w))
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = h * _P + w[i : i + n]
    return np.unique(_mix(h))


def _lacking(n: int, percent: int) -> int:
    """Shingles out of n that a linked pair may lack."""
    return n - (percent * n + 99) // 100


def _listed(n: int, percent: int) -> int:
    """Shingles that a document of n lists: a prefix and a quarter more."""
    need = _lacking(n, percent) + 1
    return min(n, need + need // 4 + 4)


def _name(s: np.ndarray) -> tuple[int, int]:
    """Two independent sums that name a set: the name, and the twin by which equal names of different sets show."""
    if not len(s):
        return 0, 0
    return tuple(int(_mix(s + np.uint64(i)).sum(dtype=np.uint64).astype(np.int64)) for i in (1, 2))


def _describe(s: np.ndarray, percent: int) -> tuple:
    node, twin = _name(s)
    bits = np.packbits((np.bincount((s & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)).view(np.int64)
    prefix = s[: _listed(len(s), percent)].view(np.int64) if len(s) > 1 else np.empty(0, np.int64)
    return node, twin, len(s), prefix, bits


def describe(df: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """(key, node, twin, n, prefix, sketch) per row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in _parts(batches):
            nodes, twins, sizes, prefixes, sketches = [], [], [], [], []
            with np.errstate(over="ignore"):
                for t in batch.column(1).to_pylist():
                    node, twin, n, prefix, bits = _describe(shingle_set(t, k, words), percent)
                    nodes.append(node)
                    twins.append(twin)
                    sizes.append(n)
                    prefixes.append(prefix)
                    sketches.append(bits)
            grid = np.array(sketches, np.int64).reshape(-1, 8)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (nodes, twins, sizes)], lists, *[pa.array(grid[:, i]) for i in range(8)]],
                [key, "node", "twin", "n", "prefix", *SKETCH],
            )

    schema = f"`{key}` {kind}, node long, twin long, n long, prefix array<long>, " + ", ".join(f"{s} long" for s in SKETCH)
    return df.select(key, text).mapInArrow(run, schema)


def whole_sets(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(node, twin, n, shingles): the whole set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in _parts(batches):
            with np.errstate(over="ignore"):
                sets = [shingle_set(t, k, words) for t in batch.column(0).to_pylist()]
                names = [_name(s) for s in sets]
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))
            columns = [[x for x, _ in names], [x for _, x in names], [len(s) for s in sets]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], lists], ["node", "twin", "n", "shingles"])

    return df.select(text).mapInArrow(run, "node long, twin long, n long, shingles array<long>")


def told_apart(sets: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """``sets`` with another name for each set among ``clashes`` (_clash): names that different sets have in common."""
    if clashes is None:
        return sets
    named = sets.join(F.broadcast(clashes), F.col("node") == F.col("_clash"), "left")
    return named.withColumn("node", F.when(F.col("_clash").isNull(), F.col("node")).otherwise(F.xxhash64("node", "twin"))).drop("_clash")


def band_of(n: int, percent: int) -> int:
    """A band is wider than sizes of linked documents are apart, so their bands are equal or adjacent."""
    return math.floor(math.log(n) / -math.log((percent - 1) / 100))


def signatures(rare: np.ndarray, frequent: np.ndarray, n: int, percent: int) -> list[int]:
    """The rare shingles of a document's prefix and the signatures of its pairs of frequent ones, in two bands."""
    need = _lacking(n, percent) + 1
    singles = np.sort(rare)[:need].view(np.int64).tolist()
    if len(singles) >= need:
        return singles
    order = np.sort(frequent).tolist()
    for band in (band_of(n, percent), band_of(n, percent) - 1):
        classes = max(1, int(_lacking(math.ceil(((percent - 1) / 100) ** -band), percent)) // 3)
        members: dict[int, list[int]] = {}
        found, have = [], len(singles)
        for t in order:
            if have >= need:
                break
            same = members.setdefault((t >> 9) % classes, [])
            have += bool(same)
            found += [(x, t) for x in same]
            same.append(t)
        if found:
            pairs = np.array(found, np.uint64)
            singles += _mix(_mix(pairs[:, 0] * _P + pairs[:, 1]) + np.uint64(band + 2)).view(np.int64).tolist()
    return singles


def extended(sets: DataFrame, percent: int) -> DataFrame:
    """(sig, node, n) from (node, n, rare, frequent): shingles by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                node, n = batch.column("node")[at].as_py(), batch.column("n")[at].as_py()
                rare, often = (batch.column(c)[at].values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("rare", "frequent"))
                with np.errstate(over="ignore"):
                    found = signatures(rare, often, n, percent)
                columns = [found, [node] * len(found), [n] * len(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["sig", "node", "n"])

    return sets.mapInArrow(run, "sig long, node long, n long")


def _similar_sizes(percent: int) -> Column:
    return F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent


def _distance() -> Column:
    total = F.lit(0)
    for s in SKETCH:
        total = total + F.bit_count(F.col(f"a{s}").bitwiseXOR(F.col(f"b{s}")))
    return total


def _near(percent: int) -> Column:
    """The parity sketches differ in no more bits than linked sets differ in shingles."""
    return _distance() * (100 + percent) <= (F.col("an") + F.col("bn")) * (100 - percent)


def _lists_allow(percent: int) -> Column:
    """The lists differ, as far as both reach, in no more shingles than linked sets do."""
    end = F.least(*[_in_order(F.element_at(f"{side}prefix", -1)) for side in "ab"])

    def reached(side: str) -> Column:
        return F.size(F.filter(f"{side}prefix", lambda t: _in_order(t) <= end))

    differ = reached("a") + reached("b") - 2 * F.size(F.array_intersect("aprefix", "bprefix"))
    return differ * (100 + percent) <= (F.col("an") + F.col("bn")) * (100 - percent)


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select([F.col(c).alias(side + c) for c in df.columns])


def _need(percent: int) -> Column:
    return F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1


def _in_order(token: Column) -> Column:
    """Hashes are unsigned; this compares as they do."""
    return token.bitwiseXOR(F.lit(-(1 << 63)))


def single_index(listed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sig, node, n) of rare shingles in prefixes; the dense nodes; the frequent shingles.

    ``listed``: (node, n, pos, token).
    """
    counts = work_table(listed.groupBy("token").count().filter("count > 1"), "shingle-counts")
    held = listed.join(counts, "token").select("token", "node", "n", "pos", (F.col("count") > FREQUENT).alias("frequent"))
    in_node = Window.partitionBy("node")
    up_to = in_node.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    need = _need(percent)
    flag = F.col("frequent").cast("int")
    held = held.withColumn("before", F.sum(flag).over(up_to)).withColumn("dense", F.least("n", need + F.floor(need / 4) + 4) - F.sum(flag).over(in_node) < need)
    held = work_table(held, "shared-shingles")
    index = held.filter(~F.col("frequent") & (F.col("pos") + 1 - F.col("before") <= need)).select(F.col("token").alias("sig"), "node", "n")
    dense = work_table(held.filter("dense").select("node").distinct(), "dense-nodes")
    return index, dense, work_table(counts.filter(F.col("count") > FREQUENT).select("token"), "frequent-shingles")


def beyond_index(tokens: DataFrame, listed: DataFrame, dense: DataFrame, frequent: DataFrame, percent: int) -> DataFrame:
    """(sig, node, n) of shingles beyond the list of a dense node, for that and for the others that list them.

    ``tokens``: (node, n, pos, token) of the whole sets of dense nodes. A shingle can only be in the prefix of a
    document of similar size if it does not come after the last one that documents of such sizes list.
    """
    band = F.floor(F.log("n") / -math.log((percent - 1) / 100)).cast("int")
    others = listed.join(bounded(dense, 32), "node", "left_anti")
    ends = others.groupBy(band.alias("_band")).agg(F.max(_in_order(F.col("token"))).alias("_end"))
    ends = ends.select(F.explode(F.array(*[F.col("_band") + i for i in (-1, 0, 1)])).alias("_band"), "_end").groupBy("_band").agg(F.max("_end").alias("_end"))
    ends = bounded(work_table(ends, "list-ends"), 64)
    need = _need(percent)
    far = tokens.filter(F.col("pos") >= F.least("n", need + F.floor(need / 4) + 4)).withColumn("_b", band).join(ends, F.col("_b") == F.col("_band")).filter(_in_order(F.col("token")) <= F.col("_end"))
    far = work_table(far.select("token", "node", "n").join(bounded(frequent, 32), "token", "left_anti"), "far-shingles")
    reached = work_table(far.select("token").distinct(), "far-tokens")
    known = others.select("token", "node", "n").join(bounded(reached, 32), "token", "left_semi")
    return far.unionByName(known).withColumnRenamed("token", "sig")


def combination_index(tokens: DataFrame, percent: int) -> DataFrame:
    """(sig, node, n) of rare shingles and pairs of frequent ones among dense nodes."""
    often = work_table(tokens.groupBy("token").count().filter(F.col("count") > FREQUENT).select("token", F.lit(True).alias("frequent")), "dense-frequent")
    marked = tokens.join(bounded(often, 64), "token", "left").withColumn("frequent", F.coalesce("frequent", F.lit(False)))
    # Frequent shingles matter only while rare ones are fewer than a prefix takes, so those far down cannot be reached.
    reach = _need(percent) * 3 + 8
    marked = marked.filter(~F.col("frequent") | (F.col("pos") <= reach))
    by_class = marked.groupBy("node", "n").agg(
        F.collect_list(F.when(~F.col("frequent"), F.col("token"))).alias("rare"), F.collect_list(F.when(F.col("frequent"), F.col("token"))).alias("frequent")
    )
    return extended(by_class, percent)


class Corpus:
    """The table that is joined: its rows by name, and whole sets of those that are asked for."""

    def __init__(self, df: DataFrame, key: str, text: str, shingle: int, percent: int) -> None:
        self.df, self.key, self.text, self.shingle, self.percent = df, key, text, shingle, percent
        rows = work_table(describe(df, key, text, shingle, percent), "shingle-prefixes")
        nodes = rows.filter("n > 0").groupBy("node").agg(F.min(key).alias("first_id"), F.min("twin").alias("low"), F.max("twin").alias("high"))
        nodes = work_table(nodes, "shingle-nodes")
        clashes = nodes.filter("low != high").select(F.col("node").alias("_clash"))
        self.clashes = clashes if clashes.limit(1).count() else None
        self.rows = told_apart(rows, self.clashes)
        self.nodes = nodes if self.clashes is None else work_table(self.rows.filter("n > 0").groupBy("node").agg(F.min(key).alias("first_id")), "shingle-nodes")
        first = self.nodes.select(F.col("node").alias("_node"), F.col("first_id").alias("_first"))
        reps = self.rows.filter("n > 1").join(bounded(first, 64), (F.col("node") == F.col("_node")) & (F.col(key) == F.col("_first")), "left_semi")
        reps = work_table(reps.select("node", "n", "prefix", *SKETCH), "representatives")
        if self.rows.filter("n > 1").groupBy(key, "node").count().filter("count > 1").limit(1).count():
            reps = work_table(reps.dropDuplicates(["node"]), "representatives")  # rows that repeat identifier and text
        self.reps = reps

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, n, shingles) of the nodes of ``wanted`` (node), read again from the texts."""
        ids = work_table(self.nodes.join(bounded(wanted, 32), "node", "left_semi").select(F.col("first_id").alias("_id")), "wanted-ids")
        texts = self.df.join(bounded(ids, 64), F.col(self.key) == F.col("_id"), "left_semi")
        found = told_apart(whole_sets(texts, self.key, self.text, self.shingle), self.clashes).drop("twin")
        return work_table(found.join(bounded(wanted, 32), "node", "left_semi").dropDuplicates(["node"]), "whole-sets")

    def index(self) -> DataFrame:
        """(sig, node, n): two linked nodes have a signature in common."""
        listed = self.reps.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
        singles, dense, frequent = single_index(listed, self.percent)
        tokens = self.sets(dense).select("node", "n", F.posexplode("shingles").alias("pos", "token"))
        beyond = beyond_index(tokens, listed, dense, frequent, self.percent)
        return work_table(singles.unionByName(beyond).unionByName(combination_index(tokens, self.percent)), "signature-index")

    def with_ends(self, pairs: DataFrame, columns: list[str]) -> DataFrame:
        """``pairs`` (a, b) with those columns of both ends, named a... and b...; reps are not shuffled for few pairs."""
        few = bounded(pairs.select("a", "b"), 48)
        first, second = (_side(self.reps.select("node", *columns), side).join(few, F.col(f"{side}node") == F.col(side)).drop(f"{side}node") for side in "ab")
        return first.join(second, ["a", "b"])

    def close_pairs(self, pairs: DataFrame) -> DataFrame:
        """(a, b, distance) of those ``pairs`` (a, b) that sketches and lists do not rule out."""
        near = self.with_ends(pairs, ["n", *SKETCH]).filter(_near(self.percent)).select("a", "b", _distance().alias("distance"))
        return self.listed_pairs(work_table(near, "near-pairs"))

    def listed_pairs(self, near: DataFrame) -> DataFrame:
        close = self.with_ends(near, ["n", "prefix"]).filter(_lists_allow(self.percent)).select("a", "b")
        return work_table(near.join(close, ["a", "b"]), "close-pairs")


def nearest(pairs: DataFrame) -> DataFrame:
    """The nearest pair of each end of ``pairs`` (a, b, distance)."""
    one_way = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    return one_way.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of ``pairs`` (a, b) whose whole sets are similar enough."""
    both = pairs.select("a", "b").join(_side(sets, "a"), F.col("a") == F.col("anode")).join(_side(sets, "b"), F.col("b") == F.col("bnode"))
    common = F.size(F.array_intersect("ashingles", "bshingles"))
    return both.filter(common * 100 >= (F.col("an") + F.col("bn") - common) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


class Links:
    """Verified links so far, their components, and the whole sets that were read for them."""

    def __init__(self, corpus: Corpus) -> None:
        self.corpus = corpus
        spark = corpus.df.sparkSession
        none = spark.range(0)  # an empty list would go through Python workers
        self.found = none.select(F.col("id").alias("u"), F.col("id").alias("v"))
        self.roots = none.select(F.col("id").alias("node"), F.col("id").alias("root"))
        self.sets = none.select(F.col("id").alias("node"), F.col("id").alias("n"), F.array("id").alias("shingles"))

    def read_sets(self, pairs: DataFrame) -> None:
        """The whole sets of the ends of ``pairs`` (a, b), unless they are there."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        self.sets = self.sets.unionByName(self.corpus.sets(work_table(ends.join(self.sets.select("node"), "node", "left_anti"), "set-ends")))

    def verify(self, pairs: DataFrame) -> None:
        self.found = self.found.unionByName(work_table(verified(pairs, self.sets, self.corpus.percent), "links"))
        self.roots = work_table(connected(self.found), "roots")

    def with_component(self, df: DataFrame, node: str, name: str) -> DataFrame:
        roots = self.roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        return df.join(bounded(roots, 48), F.col(node) == F.col("_node"), "left").withColumn(name, F.coalesce("_root", node)).drop("_node", "_root")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs`` (a, b, distance) whose ends are in different components."""
        marked = self.with_component(self.with_component(pairs, "a", "_ra"), "b", "_rb")
        return work_table(marked.filter("_ra != _rb").drop("_ra", "_rb").distinct(), "pairs-apart")


def with_pivots(index: DataFrame) -> DataFrame:
    """``index`` (sig, node, n) with the pivots of each bucket; buckets of one node are left out."""
    me = F.struct("node", "n")  # names of nodes are hashes, so their order is as good as any
    best = [F.min(F.when(F.pmod("node", F.lit(PIVOTS)) == i, me)).alias(f"p{i}") for i in range(PIVOTS)]
    chosen = index.groupBy("sig").agg(*best, F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high")
    return index.join(chosen.select("sig", F.array_compact(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("pivots")), "sig")


def pivot_pairs(held: DataFrame, percent: int) -> DataFrame:
    """(a, b): nodes of similar sizes, one of them a pivot of a bucket of the other."""
    met = held.select("node", "n", F.explode("pivots").alias("p")).filter("node != p.node")
    met = met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"), F.col("n").alias("an"), F.col("p.n").alias("bn"))
    return met.filter(_similar_sizes(percent)).select("a", "b").distinct()


def stray_pairs(here: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, distance) of members of one bucket (sig, node, n, comp) in different components, by sketches."""
    largest = here.groupBy("sig", "comp").count().groupBy("sig").agg(F.max(F.struct("count", "comp")).alias("x"), F.count(F.lit(1)).alias("comps"))
    rest = work_table(here.join(largest.filter("comps > 1").select("sig", F.col("x.comp").alias("home")), "sig"), "strays")
    low = rest.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, LOWEST).alias("low"))
    low = work_table(reps.select("node", *SKETCH).join(low, "node"), "stray-sketches")
    full = rest.join(low, "node")
    a, b = _side(full.filter("comp != home"), "a"), _side(full, "b")
    shared = F.array_intersect("alow", "blow")
    here_first = (F.size(shared) == 0) | (F.array_min(shared) == F.col("asig"))
    met = (F.col("asig") == F.col("bsig")) & (F.col("acomp") != F.col("bcomp")) & ((F.col("bcomp") == F.col("bhome")) | (F.col("anode") < F.col("bnode")))
    pairs = a.join(b, met & _similar_sizes(percent) & _near(percent) & here_first)
    return pairs.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b"), _distance().alias("distance")).distinct()


def linked(corpus: Corpus) -> DataFrame:
    """(node, root) of all nodes that are linked."""
    percent, links = corpus.percent, Links(corpus)
    held = work_table(with_pivots(corpus.index()), "pivots")
    close = corpus.close_pairs(work_table(pivot_pairs(held, percent), "pivot-pairs"))
    links.read_sets(close)
    links.verify(close)
    live = held.filter(~F.exists("pivots", lambda p: p.node == F.col("node"))).select("sig", "node", "n")
    strays = work_table(stray_pairs(links.with_component(live, "node", "comp"), corpus.reps, percent), "stray-pairs")
    left = links.apart(corpus.listed_pairs(strays))
    links.read_sets(left)
    links.verify(nearest(left))
    links.verify(links.apart(left))
    return links.roots


def named_rows(key: Column, text: Column, kind: DataType) -> Column:
    """What tells rows of another identifier or text apart; in order of identifiers, those without one last."""
    unnamed = F.lit("0").cast(kind)
    return F.struct(key.isNull().alias("no_id"), F.coalesce(key, unnamed).alias("id"), F.xxhash64(text).alias("h"), F.hash(text).alias("g"))


def jaccard_components(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) per row: documents whose sets have at least ``percent`` % in common are linked.

    ``percent`` is above 50, where a set of one shingle is linked to equal ones only.
    """
    if not 51 <= percent <= 99:
        raise ValueError("percent is from 51 to 99")
    kind = df.schema[key].dataType
    if not isinstance(kind, StructType) and df.filter(F.col(key).isNull()).limit(1).count():
        rows = df.select(named_rows(F.col(key), F.col(text), kind).alias("_row"), F.col(text).alias("_text"))
        found = jaccard_components(rows, key="_row", text="_text", shingle=shingle, percent=percent)
        name = lambda c: F.when(~F.col(f"{c}.no_id"), F.col(f"{c}.id"))
        return found.select(name("_row").alias(key), "n_shingles", name("component_id").alias("component_id"))
    corpus = Corpus(df, key, text, shingle, percent)
    roots = linked(corpus)
    named = corpus.nodes.join(bounded(roots, 48), "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    joined = named.join(bounded(work_table(roots.select("root").distinct(), "root-names"), 64), "root", "left_semi")
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = named.join(least, "root", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id"))
    out = corpus.rows.select(key, "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(of_node, "node", "left")
    return out.select(key, F.col("n").alias("n_shingles"), F.coalesce("component_id", key).alias("component_id"))
