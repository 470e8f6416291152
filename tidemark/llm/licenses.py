"""License scan: ordered signature rules over normalised words, gated by keywords, with suppression of contained hits.

The rules of ``license_rules`` are tried in their order, which is their priority. A rule owns keywords, one of which is
in whatever it matches; all words of all texts are looked up in the table of keywords, and where one is found, the
rules that own it run on the words around it, as many on either side as a match can have. Hits are word intervals: one
that lies inside another of the same or a higher priority is suppressed. The phrases of the base are rules of the
highest class, so nothing suppresses them.

Cases: null or empty texts have no words and no hits; very long texts cost in proportion to their words, as rules see
only the surroundings of keywords; of equal intervals of equal priority the first rule's stays; rows that repeat an
identifier are told apart by a hash of their text and equal rows share their hits; an empty table gives no rows; other
columns pass through, except those named like the ones added. Working columns carry the prefix ``_ls``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import word_count, words_of, work_table
from tidemark.llm.license_rules import BASE, MAX_WORDS, RULES

MAX_BROADCAST_BYTES = 32 << 20
ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keywords: tuple[str, ...]
    pattern: str
    score: float


def rules() -> list[Rule]:
    return [Rule(*r) for r in BASE + RULES]


def rule_table(spark: SparkSession, chosen: list[Rule]) -> DataFrame:
    """(_ls_word, _ls_rules): the rules that own a keyword."""
    rows = [
        F.struct(
            F.array(*map(F.lit, r.keywords)).alias("keywords"),
            F.struct(F.lit(i).alias("rule"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.score).alias("score"), F.lit(f" (?:{r.pattern})(?= )").alias("pattern")).alias("rule"),
        )
        for i, r in enumerate(chosen)
    ]
    each = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select(F.explode("r.keywords").alias("_ls_word"), "r.rule")
    return each.groupBy("_ls_word").agg(F.collect_list("rule").alias("_ls_rules"))


def spaces(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit("")))


def detect_licenses(df: DataFrame, *, key: str = "doc_id", text: str = "text", ruleset: list[Rule] | None = None, gated: bool = True) -> DataFrame:
    """Kept hits (key, text_hash, rule, label, priority, score, start, end) with words from 0, end exclusive.

    Without ``gated`` every rule runs on every whole text, which gives the same hits.
    """
    chosen = rules() if ruleset is None else ruleset
    table = rule_table(df.sparkSession, chosen)
    doc = ["_ls_key", "_ls_hash"]
    texts = df.select(F.col(key).alias("_ls_key"), F.xxhash64(text).alias("_ls_hash"), words_of(F.col(text)).alias("_ls_w"))
    if gated:
        found = texts.select(*doc, "_ls_w", F.posexplode("_ls_w").alias("_ls_pos", "_ls_here")).join(F.broadcast(table), F.col("_ls_here") == F.col("_ls_word"))
        first = F.greatest(F.col("_ls_pos") - MAX_WORDS, F.lit(0))
        around = found.select(*doc, first.alias("from"), F.slice("_ls_w", first + 1, 2 * MAX_WORDS + 1).alias("w"), "_ls_rules")
    else:
        every = table.select(F.explode("_ls_rules").alias("r")).distinct().agg(F.collect_list("r").alias("_ls_rules"))
        around = texts.select(*doc, F.lit(0).alias("from"), F.col("_ls_w").alias("w")).join(F.broadcast(every))
    ruled = around.select(*doc, "from", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("part"), F.explode("_ls_rules").alias("r"))
    pattern = F.col("r.pattern")
    matched = ruled.select(*doc, "from", "r", F.regexp_extract_all("part", pattern, F.lit(0)).alias("hit"), F.split("part", pattern, -1).alias("gap")).filter(F.size("hit") > 0)

    def place(hit: Column, i: Column) -> Column:
        before = F.concat(F.array_join(F.slice("gap", F.lit(1), i + 1), ""), F.array_join(F.slice("hit", F.lit(1), i), ""))
        return F.struct((F.col("from") + spaces(before)).alias("start"), (F.col("from") + spaces(before) + spaces(hit)).alias("end"))

    placed = matched.select(*doc, "r.rule", "r.label", "r.priority", "r.score", F.explode(F.transform("hit", place)).alias("x")).select(*doc, "rule", "label", "priority", "score", "x.*").distinct()
    earlier = Window.partitionBy(*doc).orderBy("start", F.desc("end"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for p in range(1, 1 + max(r.priority for r in chosen)):
        inside = inside | ((F.col("priority") == p) & F.coalesce(F.max(F.when(F.col("priority") <= p, F.col("end"))).over(earlier) >= F.col("end"), F.lit(False)))
    kept = placed.withColumn("inside", inside).filter(~F.col("inside"))
    return kept.select(F.col("_ls_key").alias(key), F.col("_ls_hash").alias("text_hash"), "rule", "label", "priority", "score", "start", "end")


def scan_licenses(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels and score (that of the surest hit)."""
    base = F.col("priority") == 0
    per_text = work_table(
        detect_licenses(df, key=key, text=text).groupBy(F.col(key).alias("_ls_key"), F.col("text_hash").alias("_ls_hash")).agg(
            F.sum(F.when(base, 1).otherwise(0)).alias("_ls_base"),
            F.min(F.when(base, F.col("start"))).cast("long").alias("_ls_first"),
            F.max(F.when(base, F.col("start"))).cast("long").alias("_ls_last"),
            F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("_ls_base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("_ls_labels"),
            F.max("score").alias("_ls_score"),
        ),
        "license-hits",
    )
    weight = per_text.agg(F.sum(F.octet_length("_ls_labels") * 2 + 96)).first()[0] or 0
    rows = df.drop(*ADDED).withColumn("_ls_text", F.xxhash64(text)).withColumn("n_words", word_count(F.col(text)))
    same = F.col(key).eqNullSafe(F.col("_ls_key")) & (F.col("_ls_text") == F.col("_ls_hash"))
    joined = rows.join(F.broadcast(per_text) if weight <= MAX_BROADCAST_BYTES else per_text, same, "left")
    added = {
        "n_base": F.coalesce("_ls_base", F.lit(0)).cast("long"),
        "first_word": F.col("_ls_first"),
        "last_word": F.col("_ls_last"),
        "base_labels": F.coalesce("_ls_base_labels", F.lit("")),
        "labels": F.coalesce("_ls_labels", F.lit("")),
        "score": F.coalesce("_ls_score", F.lit(0.0)),
    }
    return joined.withColumns(added).drop(*[c for c in joined.columns if c.startswith("_ls")])
