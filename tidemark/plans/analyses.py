"""The store of analyses: predictions, listings, details and a status log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of stored predictions.
SEVERITIES = ["critical", "high", "medium", "low"]
MAX_PREDICTIONS, ETA_CHARS = 6, 64
PREDICTION = "struct<title string, severity string, description string, confidence int, eta string, impact string, root_cause string, recommended_action string>"


def prediction_rows(outputs: DataFrame, *by: str, output: str = "output", limit: int = MAX_PREDICTIONS) -> DataFrame:
    """(by, position, prediction columns) from JSON ``{"predictions": [...]}``: untitled ones dropped, then the first ``limit``."""
    parsed = F.from_json(output, f"predictions array<{PREDICTION}>")["predictions"]
    titled = F.slice(F.filter(parsed, lambda p: F.trim(p.title) != ""), 1, limit)
    p = lambda c: F.col(f"p.{c}")
    severity = F.lower(F.trim(p("severity")))
    blank = lambda c: F.nullif(c, F.lit("")).alias
    return outputs.select(*by, F.posexplode(titled).alias("position", "p")).select(
        *by, "position", F.trim(p("title")).alias("title"), F.when(severity.isin(*SEVERITIES), severity).otherwise("medium").alias("severity"), blank(p("description"))("description"),
        F.greatest(F.lit(0), F.least(F.lit(100), p("confidence"))).alias("confidence"), blank(F.left(F.trim(p("eta")), F.lit(ETA_CHARS)))("eta"),
        blank(p("impact"))("impact"), blank(p("root_cause"))("root_cause"), blank(p("recommended_action"))("recommended_action"),
    )


def recent(analyses: DataFrame, user: Column | str, limit: int = 20) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit is from 1 to 100")
    return analyses.filter(F.col("user_id") == user).orderBy(F.desc("created_at"), F.desc("analysis_id")).limit(limit)


def detail(analyses: DataFrame, predictions: DataFrame, user: Column | str, analysis: Column | str) -> DataFrame:
    """One analysis of its owner with its predictions as a list in order."""
    own = analyses.filter((F.col("user_id") == user) & (F.col("analysis_id") == analysis))
    children = predictions.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("position", "title", "severity", "confidence"))).alias("predictions"))
    return own.join(children, "analysis_id", "left").withColumn("predictions", F.coalesce("predictions", F.array().cast("array<struct<position:int,title:string,severity:string,confidence:int>>")))


def logs_of(analyses: DataFrame, entries: DataFrame, analysis: Column | str) -> DataFrame:
    """The stored entries of an analysis, none if it has no pull."""
    return entries.join(F.broadcast(analyses.filter(F.col("analysis_id") == analysis).select("pull_id")), "pull_id", "left_semi")


def get_or_create(sources: DataFrame, user: str, provider: str = "manual") -> DataFrame:
    """``sources`` with a row of ``provider`` for ``user``, added where there is none."""
    new = sources.sparkSession.createDataFrame([(user, provider)], "user_id string, provider string")
    missing = new.join(sources.select("user_id", "provider"), ["user_id", "provider"], "left_anti")
    return sources.unionByName(missing, allowMissingColumns=True)


STATUS = "analysis_id long, at timestamp, status string, agent string, note string"


def append_status(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """STATUS rows to the log of an analysis: running, an agent that is done, done or failed, with a note."""
    spark.createDataFrame(rows, STATUS).coalesce(1).write.mode("append").parquet(path)


def status_of(log: DataFrame) -> DataFrame:
    """(analysis_id, status, agents, note) from STATUS rows: the last status and note, and the agents that are done, in order.

    A final status holds whatever is written at the same time; rows of one agent that repeat count once.
    """
    rank = F.when(F.col("status").isin("done", "failed"), 1).otherwise(0)
    done = F.array_sort(F.collect_set(F.when(F.col("agent").isNotNull(), F.struct("at", "agent"))))
    last = log.groupBy("analysis_id").agg(F.max_by("status", F.struct("at", rank)).alias("status"), done.alias("agents"), F.max_by("note", F.when(F.col("note").isNotNull(), F.struct("at", rank))).alias("note"))
    return last.withColumn("agents", F.array_distinct(F.transform("agents", lambda x: x.agent)))


@dataclass
class Usage:
    input_tokens: int = 0
    output_tokens: int = 0

    def add(self, other: Usage) -> None:
        self.input_tokens += other.input_tokens
        self.output_tokens += other.output_tokens


class StageFailed(RuntimeError):
    """A stage refused or said nothing; usage up to it is kept."""

    def __init__(self, stage: str, usage: Usage, done: dict[str, str]) -> None:
        super().__init__(f"stage {stage} gave no output")
        self.stage, self.usage, self.done = stage, usage, done


Agent = Callable[[str, str], tuple[str, Usage]]


def run_stages(transcript: str, agent: Agent, stages: list[str], on_done: Callable[[str, str], None] | None = None) -> tuple[dict[str, str], Usage]:
    """Stages in turn: the first reads the transcript, each later one what the others said. Runs on the driver; ``agent`` is pluggable."""
    done: dict[str, str] = {}
    usage = Usage()
    for stage in stages:
        prompt = transcript if not done else "\n\n".join(f"## {name}\n{text}" for name, text in done.items())
        text, used = agent(stage, prompt)
        usage.add(used)
        if not text.strip():
            raise StageFailed(stage, usage, done)
        done[stage] = text
        if on_done:
            on_done(stage, text)
    return done, usage
