"""Format detection: every format scores a sample of lines, the best one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.formats import ADDED
from tidemark.schema import DETECT_LINES
from tidemark.sources.files import lines_of

# The shapes of a line in each format.
CRI = r"^\d{4}-\d{2}-\d{2}T[\d:.]+(?:Z|[+-]\d{2}:\d{2})\s+(?:stdout|stderr)\s+[FP]\s"
POSTGRES = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:\s*[A-Z]{2,5}|\s*[+-]\d{2})?\s*\[\d+\]"
POSTGRES_TAG = r"\b(?:LOG|ERROR|FATAL|PANIC|WARNING|NOTICE|DETAIL|HINT|STATEMENT|CONTEXT):\s"
CLF = r'^\S+ \S+ \S+ \[[^\]]+\] "(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|TRACE|CONNECT)[^"]*" \d{3} '
SYSLOG5424 = r"^<\d{1,3}>1 "
SYSLOG = r"^(?:<\d{1,3}>)?[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2} \S+ [^\s:\[]+(?:\[\d+\])?:"
LOGFMT_PAIR = r"""(?:^|\s)([A-Za-z_][\w.\-]*)=("[^"]*"|'[^']*'|[^\s"']*)"""
#: Ties go to the earlier format; formats of a user come last.
PRECEDENCE = ["json", "cri", "postgres", "clf", "syslog5424", "syslog", "logfmt"]
FLOOR = 0.30


def tree_of(line: Column) -> Column:
    """A line that is a JSON object as a variant, else null."""
    text = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return F.try_parse_json(F.when(text.startswith("{"), text))


def as_object(line: Column) -> Column:
    """A line that is a JSON object as a map of values, else null."""
    return tree_of(line).cast("map<string,variant>")


def json_flavor(doc: Column) -> Column:
    """The producer of a JSON event by its keys; ``doc`` maps keys to JSON texts."""

    def has(*keys: str) -> Column:
        found = F.lit(False)
        for k in keys:
            found = found | F.map_contains_key(doc, k)
        return found

    whole_level = F.rlike(F.element_at(doc, "level"), F.lit(r"^-?\d+$|^true$|^false$"))
    return (
        F.when(has("resourceLogs", "resource_logs"), "otlp")
        .when(has("logging.googleapis.com/trace", "insertId", "jsonPayload"), "gcp")
        .when(has("severity") & F.element_at(doc, "resource").startswith("{"), "gcp")
        .when(has("dd", "dd.trace_id", "ddsource"), "datadog")
        .when(has("ecs") | has("@timestamp") & has("log.level", "log"), "ecs")
        .when(has("body", "Body") & has("severityText", "SeverityText"), "otlp")
        .when(has("log") & has("stream") & has("time"), "docker")
        .when(has("v") & has("msg") & whole_level, "bunyan")
        .when(whole_level & has("time", "msg"), "pino")
        .otherwise("generic")
    )


def texts_of(doc: Column) -> Column:
    """A map of variants as a map of JSON texts."""
    return F.transform_values(doc, lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))


def sample(lines: DataFrame, limit: int = DETECT_LINES) -> DataFrame:
    in_file = Window.partitionBy("file_idx").orderBy("line_no")
    return lines.select("file_idx", "line_no", "line").withColumn("rank", F.row_number().over(in_file)).filter(F.col("rank") <= limit)


def detect(sources: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(file_idx, format, confidence, flavor, evidence, overridden) per source; ``lines`` where sources hold no content."""
    if lines is None:  # a declared format is not looked for
        lines = lines_of(sources.filter(F.coalesce("format", F.lit("")) == ""), "file_idx", first=DETECT_LINES)
    lines = sample(lines)
    marked = lines.withColumn("doc", texts_of(as_object(F.col("line")))).withColumns(
        {
            "is_json": F.col("doc").isNotNull(),
            "flavor": F.when(F.col("doc").isNotNull(), json_flavor(F.col("doc"))),
            "is_cri": F.rlike("line", F.lit(CRI)),
            "is_postgres": F.rlike("line", F.lit(POSTGRES)),
            "is_tagged": F.rlike("line", F.lit(POSTGRES_TAG)),
            "is_clf": F.rlike("line", F.lit(CLF)),
            "is_syslog5424": F.rlike("line", F.lit(SYSLOG5424)),
            "is_syslog": F.rlike("line", F.lit(SYSLOG)),
            "is_logfmt": F.regexp_count("line", F.lit(LOGFMT_PAIR)) >= 3,
            **{f"is_{f.name}": F.rlike("line", F.lit(f.start or f.line)) for f in ADDED.values()},
        }
    )
    order = [*PRECEDENCE, *ADDED]

    def share(flag: str) -> Column:
        return F.avg(F.col(flag).cast("int"))

    tagged = F.when(share("is_postgres") > 0, share("is_postgres") * 0.5 + F.least(share("is_tagged") * 2, F.lit(1.0)) * 0.5).otherwise(0.0)
    scores = marked.groupBy("file_idx").agg(
        *[(tagged if f == "postgres" else share(f"is_{f}")).alias(f"s_{f}") for f in order],
        *[F.min_by(F.when(F.col(f"is_{f}"), F.left("line", F.lit(200))), F.when(F.col(f"is_{f}"), F.col("rank"))).alias(f"e_{f}") for f in order],
    )
    votes = marked.filter("is_json").groupBy("file_idx", "flavor").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    votes = votes.groupBy("file_idx").agg(F.min_by("flavor", F.struct(-F.col("n"), "first")).alias("flavor"))
    ranked = F.array_max(F.array(*[F.struct(F.col(f"s_{f}").alias("score"), F.lit(-i).alias("order"), F.lit(f).alias("format"), F.col(f"e_{f}").alias("evidence")) for i, f in enumerate(order)]))
    best = scores.join(votes, "file_idx", "left").select("file_idx", ranked.alias("best"), F.col("flavor").alias("voted"))
    found = sources.select("file_idx", F.nullif("format", F.lit("")).alias("asked"), F.col("format").isNotNull().alias("overridden")).join(best, "file_idx", "left")
    sure = F.col("best.score") >= FLOOR
    return found.select(
        "file_idx",
        F.coalesce("asked", F.when(sure, F.col("best.format")), F.lit("plain")).alias("format"),
        F.when(F.col("asked").isNotNull(), 1.0).when(F.col("best").isNull(), 0.0).when(sure, F.col("best.score")).otherwise(1 - F.col("best.score")).alias("confidence"),
        F.when(F.col("asked").isNull() & sure & (F.col("best.format") == "json"), F.col("voted")).alias("flavor"),
        F.when(F.col("asked").isNull() & sure, F.col("best.evidence")).alias("evidence"),
        "overridden",
    )


def reference_year(sources: DataFrame, lines: int = DETECT_LINES) -> int | None:
    """The year of the first line, in file order, whose text begins with one from 2000 to 2100; null if none does."""
    head = sources.select("file_idx", F.posexplode(F.slice(F.split("content", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), 1, lines)).alias("pos", "line"))
    year = head.select("file_idx", "pos", F.regexp_extract("line", r"(?U)^\s*([0-9]{4})", 1).try_cast("int").alias("year"))
    return year.filter("year between 2000 and 2100").agg(F.min_by("year", F.struct("file_idx", "pos"))).first()[0]
