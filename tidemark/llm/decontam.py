"""Benchmark decontamination: test n-grams as a broadcast hash set, probed by every window of every text.

Texts and items are cut into words after A-Z are lower-cased. The windows of an item are its runs of ``n`` words, or
all its words if it has fewer. Distinct windows are the build side of a hash join, broadcast while their measured size
stays below ``MAX_BROADCAST_BYTES``. Every position of a text first asks the set of the hashes of the windows' first
``PREFIX`` words, in which each hash is once, however many windows begin so; only where that is found the whole window is
put together and looked up, by equality. Only hits leave the scan.

Beyond that size each position is hashed over the whole windows that start there, one hash a length. Hashes, places and
identifiers alone are shuffled to the windows, in salted parts, so that a window that very many texts share is no task's
own; what meets is verified in the texts that hold it, which are joined once.

Cases: null or empty texts have no words and no hits; null or wordless items have no windows; items that repeat count
as the identifiers they carry (null identifiers are left out of the list of items); rows that repeat an identifier
are told apart by a hash of their text; hits that overlap count their words once; very long texts are scanned whole,
in one row each; empty tables give no hits; other columns pass through, except those named like the ones added
(n_words, n_hit, hit_spans, hit_items). Working columns carry the prefix ``_dc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import word_count, words_of, work_table

MAX_BROADCAST_BYTES = 64 << 20
#: First words of a window whose hash tells where a window may start.
PREFIX = 3
#: Parts into which texts are dealt when windows are shuffled.
SALT = 16


def item_windows(items: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(gram, length, items): distinct windows, and the identifiers of the items that hold them."""
    words = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(n))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    each = words.withColumn("length", length).select("item", "length", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("length")), " "))).alias("gram"))
    return each.groupBy("gram", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _hash(size: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(size), *words)


def _first_words(parts: Column, size: int) -> Column:
    return _hash(size, [F.get(parts, F.lit(j)) for j in range(size)])


def find_hits(docs: DataFrame, windows: DataFrame, key: list[str]) -> DataFrame:
    """(key, start, length, gram) for every window of ``docs`` (key, w) that an item holds; start counts words from 0."""
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # at most n values
    if not lengths:
        return docs.select(*key, F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("gram")).limit(0)
    weight = windows.agg(F.sum(F.octet_length("gram") + 64)).first()[0]
    return _scanned(docs, windows, key, lengths) if weight <= MAX_BROADCAST_BYTES else _shuffled(docs, windows, key, lengths)


def _scanned(docs: DataFrame, windows: DataFrame, key: list[str], lengths: list[int]) -> DataFrame:
    """``find_hits`` with both build sides broadcast."""
    sizes = sorted({min(n, PREFIX) for n in lengths})
    parts, hashed = F.split("gram", " "), F.lit(None).cast("long")
    for p in sizes:
        hashed = F.when(F.least("length", F.lit(PREFIX)) == p, _first_words(parts, p)).otherwise(hashed)
    prefixes = windows.groupBy(hashed.alias("_dc_prefix")).agg(F.collect_set("length").alias("_dc_lengths"))

    # One hash a position for each prefix size; near the end of a text it covers fewer words and no window fits.
    def probes(p: int) -> Column:
        return F.transform("w", lambda word, i: _hash(p, [word] + [F.get("w", i + j) for j in range(1, p)]))

    at = docs.select(*key, "w", F.posexplode(F.concat(*[probes(p) for p in sizes])).alias("_dc_pos", "_dc_probe"))
    found = at.join(F.broadcast(prefixes), F.col("_dc_probe") == F.col("_dc_prefix"))
    # A window is looked up at the probe of its own prefix size only.
    own = F.floor(F.col("_dc_pos") / F.size("w"))
    place = F.array_position(F.array(*map(F.lit, sizes)), F.least("_dc_length", F.lit(PREFIX))) - 1
    start = F.pmod("_dc_pos", F.size("w"))
    each = found.select(*key, "w", start.alias("start"), own.alias("_dc_own"), F.explode("_dc_lengths").alias("_dc_length"))
    each = each.filter((F.col("_dc_own") == place) & (F.col("start") + F.col("_dc_length") <= F.size("w")))
    here = each.select(*key, "start", F.array_join(F.slice("w", F.col("start") + 1, F.col("_dc_length")), " ").alias("_dc_gram"), "_dc_length")
    known = F.broadcast(windows.select("gram", "length"))
    return here.join(known, (F.col("_dc_gram") == F.col("gram")) & (F.col("_dc_length") == F.col("length"))).select(*key, "start", "length", "gram")


def _shuffled(docs: DataFrame, windows: DataFrame, key: list[str], lengths: list[int]) -> DataFrame:
    """``find_hits`` by hashes of whole windows, without texts in the shuffle to the windows."""

    def whole(n: int) -> Column:
        hashes = F.transform("w", lambda word, i: F.struct(i.cast("int").alias("start"), F.lit(n).alias("length"), _hash(n, [word] + [F.get("w", i + j) for j in range(1, n)]).alias("h")))
        return F.slice(hashes, F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(0)))

    at = docs.select(*key, F.explode(F.concat(*[whole(n) for n in lengths])).alias("x")).select(*key, "x.start", "x.length", F.col("x.h").alias("_dc_h"))
    at = at.withColumn("_dc_part", F.pmod(F.xxhash64(*key), F.lit(SALT)))
    hashed = F.lit(None).cast("long")
    for n in lengths:
        hashed = F.when(F.col("length") == n, _first_words(F.split("gram", " "), n)).otherwise(hashed)
    build = windows.select(hashed.alias("_dc_hash"), F.col("length").alias("_dc_length"), "gram", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_dc_salt"))
    same = (F.col("_dc_h") == F.col("_dc_hash")) & (F.col("length") == F.col("_dc_length")) & (F.col("_dc_part") == F.col("_dc_salt"))
    met = work_table(at.join(build, same).select(*key, "start", "length", "gram"), "bench-met")
    texts = docs.select(*[F.col(c).alias(f"{c}_of") for c in key], "w").dropDuplicates([f"{c}_of" for c in key])
    of = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in key]
    sure = F.array_join(F.slice("w", F.col("start") + 1, F.col("length")), " ") == F.col("gram")
    return met.join(texts, of).filter(sure).select(*key, "start", "length", "gram")


def covered(spans: Column) -> Column:
    """Number of positions in the union of (start, end) spans, end exclusive."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
    return F.aggregate(
        F.array_sort(spans),
        zero,
        lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0), s.end - F.greatest(s.start, acc.until))).alias("n"), F.greatest(acc.until, s.end).alias("until")),
        lambda acc: acc.n,
    )


def contamination(df: DataFrame, items: DataFrame, *, n: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_dc_key, _dc_hash, _dc_hits, _dc_items) per distinct text with a hit: hits are (start, end) words, items sorted ids."""
    windows = work_table(item_windows(items, n), "bench-windows")
    docs = df.select(F.col(key).alias("_dc_key"), F.xxhash64(text).alias("_dc_hash"), words_of(F.col(text)).alias("w"))
    doc = ["_dc_key", "_dc_hash"]
    hits = work_table(find_hits(docs.withColumnRenamed("_dc_hash", "_dc_text"), windows, ["_dc_key", "_dc_text"]).withColumnRenamed("_dc_text", "_dc_hash"), "bench-hits")
    spans = hits.groupBy(*doc).agg(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))).alias("_dc_hits"))
    weight = windows.agg(F.sum(F.octet_length("gram") + 64 + F.size("items") * 40)).first()[0] or 0
    named = windows.select(F.col("gram").alias("_dc_gram"), "items")
    held = hits.select(*doc, "gram").distinct().join(F.broadcast(named) if weight <= MAX_BROADCAST_BYTES else named, F.col("gram") == F.col("_dc_gram"))
    held = held.groupBy(*[F.col(c).alias(c + "2") for c in doc]).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_dc_items"))
    same = F.col("_dc_key").eqNullSafe(F.col("_dc_key2")) & (F.col("_dc_hash") == F.col("_dc_hash2"))
    return spans.join(held, same, "left").select(*doc, "_dc_hits", F.coalesce("_dc_items", F.array().cast("array<string>")).alias("_dc_items"))


def _marked(df: DataFrame, found: DataFrame, key: str, text: str, how: str) -> DataFrame:
    """``df`` joined with rows of ``found`` (_dc_key, _dc_hash, ...) by identifier and text."""
    same = F.col(key).eqNullSafe(F.col("_dc_key")) & (F.col("_dc_text") == F.col("_dc_hash"))
    weight = found.agg(F.sum(F.size("_dc_hits") * 8 + F.size("_dc_items") * 40 + 64)).first()[0] or 0
    return df.withColumn("_dc_text", F.xxhash64(text)).join(F.broadcast(found) if weight <= MAX_BROADCAST_BYTES else found, same, how)


def with_contamination(df: DataFrame, items: DataFrame, *, n: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with n_words, n_hit, hit_spans and hit_items; texts without a hit get 0 and empty lists."""
    found = work_table(contamination(df, items, n=n, key=key, text=text), "bench-found")
    base = df.drop("n_words", "n_hit", "hit_spans", "hit_items").withColumn("n_words", word_count(F.col(text)))
    return (
        _marked(base, found, key, text, "left")
        .withColumn("n_hit", F.coalesce(covered(F.col("_dc_hits")), F.lit(0)).cast("long"))
        .withColumn("hit_spans", F.coalesce(F.array_sort("_dc_hits"), F.array().cast("array<struct<start:int,end:int>>")))
        .withColumn("hit_items", F.coalesce("_dc_items", F.array().cast("array<string>")))
        .drop("_dc_key", "_dc_hash", "_dc_text", "_dc_hits", "_dc_items")
    )


def decontaminate(df: DataFrame, items: DataFrame, *, n: int = 10, action: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without contaminated documents, or with the hit words and what precedes each cut out of them."""
    if action not in ("documents", "spans"):
        raise ValueError("action is 'documents' or 'spans'")
    found = work_table(contamination(df, items, n=n, key=key, text=text), "bench-found")
    if action == "documents":
        return _marked(df, found, key, text, "left_anti").select(*df.columns)
    marked = _marked(df.withColumn("_dc_old", F.col(text)), found, key, "_dc_old", "left")
    piece = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all(F.col("_dc_old"), F.lit(piece), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists("_dc_hits", lambda s: (s.start <= i) & (i < s.end)))
    rest = F.regexp_extract(F.col("_dc_old"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    return marked.withColumn(text, F.when(F.col("_dc_hits").isNotNull(), F.concat(F.array_join(kept, ""), rest)).otherwise(F.col("_dc_old"))).select(*df.columns)
