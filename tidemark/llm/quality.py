"""Quality rules with risk-controlled thresholds.

Per text: words, symbols, repeated lines and repeated word triples, from which come rates. Labelled documents of
quality 1 are the holdout: an identifier is one draw, with the highest rates of its rows, and equal texts under several
identifiers are one draw. ``LEVELS`` are sets of cutoffs for all rates, each stricter than the one before. Per
stratum they are tried in this order, and a level is accepted while the exact binomial test shows that at most
``alpha`` of the good documents of the stratum exceed any of its cutoffs. The last accepted level rules; a stratum
without enough labels gets none and rejects nothing beyond the base. Testing stops at the first failure
(fixed-sequence testing), and ``delta`` is divided by the number of strata (Bonferroni), so all accepted levels hold at
once with probability ``1 - delta``. The holdout is taken as drawn from the documents to be judged; near copies in it
that are not equal count as draws of their own.

Cases: null text: no words, base fails. Null stratum: a stratum of its own. Documents without labels do not enter the
holdout; several labels of one document count as one good label if any is 1 and none is 0; rows that repeat an
identifier are one draw. A rate equal to its cutoff passes. Very long texts are read whole, one at a time. Empty
tables: no rows, or no cutoffs. Other columns pass through, except those named like the metrics, rates and verdicts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import work_table

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"

RATES = ["symbol_rate", "dup_line_rate", "repeat_rate", "long_word_rate"]
#: Cutoffs of RATES, loosest level first.
LEVELS = [
    (0.50, 0.90, 0.90, 40.0),
    (0.40, 0.80, 0.80, 30.0),
    (0.30, 0.70, 0.70, 25.0),
    (0.20, 0.60, 0.60, 20.0),
    (0.15, 0.50, 0.50, 17.0),
    (0.10, 0.45, 0.45, 15.0),
    (0.08, 0.40, 0.40, 13.5),
    (0.06, 0.35, 0.35, 12.5),
    (0.05, 0.30, 0.30, 12.0),
]
MAX_BROADCAST_BYTES = 8 << 20


def text_metrics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The METRICS of one text."""
    if not text:
        return 0, 0, 0, 0, 0, 1
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII blanks only
    blank = len(raw) - len(raw.translate(None, _BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = raw.split(b"\n")
    dups = 0
    if len(lines) > 1:
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                dups += 1
            elif line.strip(_BLANKS):
                seen.add(line)
    return len(words), len(text) - blank, symbols, dups, repeated_words(words), len(lines)


def repeated_words(words: list[bytes]) -> int:
    """Words inside triples that occur at least twice."""
    triples = list(zip(words, words[1:], words[2:]))
    if len(set(triples)) == len(triples):
        return 0
    times = Counter(triples)
    n, until = 0, 0
    for i, t in enumerate(triples):
        if times[t] > 1:
            n += i + 3 - max(i, until)
            until = i + 3
    return n


def with_metrics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with METRICS and text_hash as longs."""
    names = [c for c in (df.columns if keep is None else keep) if c not in [*METRICS, "text_hash"]]
    kept = [*names, "text_hash"]
    needed = df.select(*names, F.xxhash64(text).alias("text_hash"), F.col(text).alias("_metrics_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in needed.select(*kept).schema] + [f"{m} long" for m in METRICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_metrics(t) for t in batch.column("_metrics_text").to_pylist()]
            columns = list(zip(*found)) or [()] * len(METRICS)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(c, pa.int64()) for c in columns], kept + METRICS)

    return needed.mapInArrow(run, schema)


def with_rates(df: DataFrame) -> DataFrame:
    def rate(top: str, below: str) -> Column:
        return F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(F.lit(0.0))

    pairs = [("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("word_chars", "n_words")]
    return df.withColumns({name: rate(*pair) for name, pair in zip(RATES, pairs)})


def quality_weight() -> Column:
    """A sampling weight in (0, 1] from the rates: the parts of a text that are neither symbols nor repeats."""
    solid = [1 - F.least(F.col(r), F.lit(0.95)) for r in RATES[:3]]
    return solid[0] * solid[1] * solid[2]


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial with n draws of probability p, summed from the largest term down."""
    if k >= n:
        return 1.0
    logs = math.log(p), math.log1p(-p)
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * logs[0] + (n - k) * logs[1]
    total, term, i = 1.0, 1.0, k
    while i > 0 and term > total * 1e-17:
        term *= i / (n - i + 1) * math.exp(logs[1] - logs[0])
        total += term
        i -= 1
        if total > 1e280:  # k is far above the mean
            return 1.0
    return min(1.0, math.exp(min(0.0, top + math.log(total))))


def strictest(exceed: list[int], n: int, alpha: float, level: float) -> int | None:
    """The last of a sequence of cutoffs whose test, and those of all before it, reject a rate above ``alpha``."""
    chosen = None
    for i, k in enumerate(exceed):
        if n == 0 or binomial_tail(k, n, alpha) > level:
            break
        chosen = i
    return chosen


def over(cutoffs: list[Column]) -> Column:
    out = F.lit(False)
    for rate, cutoff in zip(RATES, cutoffs):
        out = out | F.coalesce(F.col(rate) > cutoff, F.lit(False))
    return out


def risk_cutoffs(good: DataFrame, stratum: str, *, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """(_q_stratum, cut_<rate>...) from the rates of independent good documents; one row per stratum."""
    counts = good.groupBy(F.col(stratum).alias("_q_stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(over([F.lit(c) for c in level]).cast("long")) for level in LEVELS]).alias("exceed")
    )
    counts = counts.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy()))  # a row for each stratum
    kind = good.schema[stratum].dataType.simpleString()
    names = [f"cut_{r}" for r in RATES]
    schema = f"_q_stratum {kind}, " + ", ".join(f"{c} double" for c in names)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = [strictest(r["exceed"], r["n"], alpha, delta / r["strata"]) for r in batch.to_pylist()]
            cuts = [pa.array([None if i is None else LEVELS[i][c] for i in levels], pa.float64()) for c in range(len(RATES))]
            yield pa.RecordBatch.from_arrays([batch.column("_q_stratum"), *cuts], ["_q_stratum", *names])

    return counts.mapInArrow(choose, schema)


def good_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Identifiers whose labels say quality 1 and nothing else."""
    return labels.groupBy(key).agg(F.min("quality").alias("_q")).filter("_q = 1").select(key)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def verdict(rated: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``rated`` with base_failed and kept; ``cutoffs`` as of risk_cutoffs."""
    names = [f"cut_{r}" for r in RATES]
    weight = cutoffs.agg(F.sum(F.coalesce(F.octet_length(F.col("_q_stratum").cast("string")), F.lit(0)) + 96)).first()[0] or 0
    rows = rated.drop("base_failed", "kept", *names)
    joined = rows.join(F.broadcast(cutoffs) if weight <= MAX_BROADCAST_BYTES else cutoffs, F.col(stratum).eqNullSafe(F.col("_q_stratum")), "left")
    kept = ~F.col("base_failed") & ~over([F.col(c) for c in names])
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", kept).drop("_q_stratum", *names)


def independent(good: DataFrame, key: str, stratum: str) -> DataFrame:
    """One row for each document of a stratum, with the highest rates of its rows; documents of equal texts are one."""
    highest = [F.max(c).alias(c) for c in RATES]
    return good.groupBy(stratum, "text_hash").agg(F.min(key).alias(key), *highest).groupBy(key, stratum).agg(*highest)


def fitted_cutoffs(rated: DataFrame, labels: DataFrame, *, key: str = "doc_id", stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """Cutoffs from the rates of the labelled good documents among ``rated`` that pass the base."""
    good = rated.filter(~base_failed()).join(good_ids(labels, key), key, "left_semi")
    return work_table(risk_cutoffs(independent(good, key, stratum), stratum, alpha=alpha, delta=delta), "quality-cutoffs")
