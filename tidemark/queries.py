"""Queries over the driver's tables: logs are rendered from events and orders, read back and compared.

``QUERIES`` maps names to functions of (spark, sf_dir); ``ORACLES`` holds the SQL that gives the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import formats
from tidemark.functions import levels, stamps
from tidemark.functions.text import file_stem
from tidemark.operators import detect as detection
from tidemark.operators import flows as flowing
from tidemark.operators import fold as folding
from tidemark.operators import normalize, redact, report, rhythm, scan
from tidemark.operators import parse as parsing
from tidemark.operators import templates as templating
from tidemark.plans import analyses, cost, prompts
from tidemark.plans.ingest import Ingested, ingest, ingest_lines
from tidemark.sources import tail as tailing
from tidemark.sources.files import LINE_ENDS
from tidemark.stored import settled, shared_folder, tabled
from tidemark.streaming import files as growing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- rendering -------------------------------------------------------------------------------------------------------

STAMP = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
LEVEL = "case event_type when 'error' then 'error' when 'click' then 'debug' when 'purchase' then 'warn' else 'info' end"
PRIORITY = "case event_type when 'error' then 131 when 'click' then 135 when 'purchase' then 132 else 134 end"
NUMBER = "case event_type when 'error' then 50 when 'click' then 20 when 'purchase' then 40 else 30 end"
STATUS = "case event_type when 'error' then 500 when 'purchase' then 404 else 200 end"
LINES = {
    "plain": f"concat({STAMP}, 'Z ', upper({LEVEL}), ' [svc.', event_type, '] event ', event_id, ' done')",
    "logfmt": f"""concat('ts=', {STAMP}, 'Z level=', {LEVEL}, ' msg="event ', event_id, ' done" svc=svc.', event_type, ' user_id=', user_id, ' trace_id=t', event_id)""",
    "json": f"""concat('{{"timestamp":"', {STAMP}, 'Z","level":"', {LEVEL}, '","message":"event ', event_id, ' done","service":"svc.', event_type, '","user_id":', user_id, ',"trace_id":"t', event_id, '"}}')""",
    "clf": f"""concat('10.0.0.', user_id % 250, ' - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] "GET /e/', event_id, ' HTTP/1.1" ', {STATUS}, ' 12 "-" "x" request_id=req-', event_id)""",
    "syslog": f"concat('<', {PRIORITY}, '>', date_format(ts, 'MMM'), ' ', lpad(day(ts), 2, ' '), ' ', date_format(ts, 'HH:mm:ss'), ' host1 svc.', event_type, '[', user_id, ']: event ', event_id, ' done')",
    "syslog5424": f"""concat('<', {PRIORITY}, '>1 ', {STAMP}, 'Z host1 svc.', event_type, ' ', user_id, ' M1 [ctx request_id="r', event_id, '"] event ', event_id, ' done')""",
    "postgres": f"concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), ' UTC [', user_id, '] app@shop ', case event_type when 'error' then 'ERROR' when 'purchase' then 'WARNING' else 'LOG' end, ':  event ', event_id, ' done')",
    "cri": f"""concat({STAMP}, 'Z stdout P event ', event_id, '\\n', {STAMP}, 'Z stdout F  done')""",
}
SUFFIX = {"json": "json"}
FILES = 8
#: Events of one file; more of them make more batches of ``FILES`` files.
PER_FILE = 50_000
#: What a string can hold in Spark, which fails beyond it: no file is cut.
NO_CUT = 2**31 - 1


def sources(spark: SparkSession, sf_dir: str, fmt: str, line: str | None = None, declared: bool = True) -> DataFrame:
    """Events as files of one format, in order of their identifiers; file i of each batch has the name of file i."""
    batch = F.floor(F.col("event_id") / (FILES * PER_FILE))
    events = table(spark, sf_dir, "events").select((batch * FILES + F.col("event_id") % FILES).cast("int").alias("file_idx"), "event_id", F.expr(line or LINES[fmt]).alias("line"))
    whole = events.groupBy("file_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x.line), "\n").alias("content"))
    fixed = {"service": None, "role": "backend", "format": fmt if declared else None, "timezone": None}
    return whole.select("file_idx", F.concat(F.lit("app"), F.col("file_idx") % FILES, F.lit(".log")).alias("name"), "content", *[F.lit(v).cast("string").alias(c) for c, v in fixed.items()], F.lit(0).alias("offset_seconds"))


def long_files(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    """(file_id, name, line_no, line): events as ``FILES`` files, however long, of which no task holds one; they are numbered once."""
    events = table(spark, sf_dir, "events").select((F.col("event_id") % FILES).alias("file"), "event_id", F.expr(line).alias("line")).filter("line is not null")
    place = F.lit(1 << 61) + F.col("event_id")  # not below 0
    rows = scan.before(events.withColumn("place", place), ["file"], "place", {"earlier": (F.regexp_count("line", F.lit(LINE_ENDS)) + 1, "sum")}, order=["line"])
    pieces = rows.select(F.concat(F.lit("f"), "file").alias("file_id"), F.concat(F.lit("app"), "file", F.lit(".log")).alias("name"), "earlier", F.posexplode_outer(F.split("line", LINE_ENDS, -1)).alias("pos", "line"))
    return tabled(pieces.select("file_id", "name", (F.coalesce("earlier", F.lit(0)) + F.col("pos") + 1).alias("line_no"), "line").filter(F.rlike("line", F.lit(r"(?U)\S"))))


def ingest_all(batch: DataFrame) -> Ingested:
    """``batch`` without any budget."""
    return ingest(batch, max_entries=None, max_bytes=NO_CUT, year=2024)


def read(spark: SparkSession, sf_dir: str, fmt: str) -> Ingested:
    return ingest_all(sources(spark, sf_dir, fmt))


EVENT_ID = r"event (\d+)"


def compared(entries: DataFrame, pattern: str = EVENT_ID) -> DataFrame:
    return entries.select(
        F.regexp_extract("message", pattern, 1).cast("bigint").alias("event_id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("stamp"),
        "level", "service", "message", "time_source",
    )


def expected(stamp: str = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')", level: str = LEVEL, service: str = "'svc.' || event_type", message: str = "'event ' || event_id || ' done'", source: str = "'offset'") -> str:
    return f"select event_id, {stamp} as stamp, {level} as level, {service} as service, {message} as message, {source} as time_source from events"


SECONDS = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000000'"
FILE = "'app' || (event_id % 8)"


@query(expected())
def parse_plain(spark, sf_dir):
    return compared(read(spark, sf_dir, "plain").entries)


@query(expected())
def parse_logfmt(spark, sf_dir):
    return compared(read(spark, sf_dir, "logfmt").entries)


@query(expected())
def parse_json(spark, sf_dir):
    return compared(read(spark, sf_dir, "json").entries)


@query(expected(SECONDS, "case event_type when 'error' then 'error' when 'purchase' then 'warn' else 'info' end", FILE, f"'GET /e/' || event_id || ' → ' || {STATUS}"))
def parse_clf(spark, sf_dir):
    return compared(read(spark, sf_dir, "clf").entries, r"/e/(\d+)")


@query(expected("'2024' || substr(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 5) || '.000000'", source="'assumed'"))
def parse_syslog(spark, sf_dir):
    return compared(read(spark, sf_dir, "syslog").entries)


@query(expected())
def parse_syslog5424(spark, sf_dir):
    return compared(read(spark, sf_dir, "syslog5424").entries)


@query(expected("strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '000'", "case event_type when 'error' then 'error' when 'purchase' then 'warn' else 'info' end", FILE, source="'assumed'"))
def parse_postgres(spark, sf_dir):
    return compared(read(spark, sf_dir, "postgres").entries)


@query(expected(level="'info'", service=FILE))
def cri_partials(spark, sf_dir):
    """Each event is two fragments of one line."""
    return compared(read(spark, sf_dir, "cri").entries)


@query("select event_id, cast(epoch_us(ts) as bigint) as us, 'cart' as service, event_type as kind, cast(user_id as varchar) as user_text, 'lib' as scope from events")
def parse_otlp_envelope(spark, sf_dir):
    """All events of a user in one envelope on one line."""
    record = """concat('{"timeUnixNano":"', unix_micros(cast(ts as timestamp)), '000","severityText":"INFO","body":{"stringValue":"event ', event_id, '"},"attributes":[{"key":"kind","value":{"stringValue":"', event_type, '"}},{"key":"user","value":{"intValue":"', user_id, '"}}]}')"""
    events = table(spark, sf_dir, "events")
    n_files = max(FILES, -(-events.count() // PER_FILE))
    grouped = events.groupBy((F.col("user_id") % n_files).cast("int").alias("file_idx"), "user_id").agg(F.array_join(F.collect_list(F.expr(record)), ",").alias("records"))
    line = F.concat(F.lit('{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"cart"}}]},"scopeLogs":[{"scope":{"name":"lib"},"logRecords":['), F.col("records"), F.lit("]}]}]}"))
    files = grouped.groupBy("file_idx").agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    batch = files.selectExpr("file_idx", "concat('o', file_idx, '.json') name", "content", "cast(null as string) service", "'backend' role", "cast(null as string) format", "cast(null as string) timezone", "0 offset_seconds")
    e = ingest_all(batch).entries
    return e.select(
        F.regexp_extract("message", EVENT_ID, 1).cast("bigint").alias("event_id"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), "service",
        F.get_json_object(F.concat(F.lit("["), F.col("attributes")["kind"], F.lit("]")), "$[0]").alias("kind"), F.col("attributes")["user"].alias("user_text"),
        F.get_json_object(F.concat(F.lit("["), F.col("attributes")["scope.scope.name"], F.lit("]")), "$[0]").alias("scope"),
    )


@query("select event_id, cast(user_id as varchar) as user_key, 't' || event_id as trace_id, cast(user_id as varchar) as attribute from events")
def correlation_keys(spark, sf_dir):
    e = read(spark, sf_dir, "json").entries
    return e.select(F.regexp_extract("message", EVENT_ID, 1).cast("bigint").alias("event_id"), F.col("correlation_keys")["user_id"].alias("user_key"), "trace_id", F.col("attributes")["user_id"].alias("attribute"))


@query("select event_id, cast(2 + event_id % 3 as integer) as n_lines from events")
def fold_stack_traces(spark, sf_dir):
    frames = r"concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z ERROR event ', event_id, ' failed', repeat('\n    at com.shop.Cart.add(Cart.java:7)', int(1 + event_id % 3)))".replace('\\"', '"')
    e = ingest_all(sources(spark, sf_dir, "plain", frames)).entries
    return e.select(F.regexp_extract("message", EVENT_ID, 1).cast("bigint").alias("event_id"), (F.regexp_count("message", F.lit("\n")) + 1).cast("int").alias("n_lines"))


GROWING = ["plain", "postgres", "cri", "json"]


@query(
    """with told as (select event_id, event_type, event_id % 8 as file, event_id % 4 as kind, event_id // 8 as n, ts from events),
  own as (select *, case when kind = 3 and n % 5 = 4 then null when kind = 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '000' else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end as own from told),
  dated as (select *, last_value(own ignore nulls) over (partition by file order by event_id) as stamp from own)
select event_id, cast(case kind when 0 then 2 + n % 3 when 1 then 1 + n % 2 when 2 then 2 else 1 end as integer) as n_lines, stamp,
  case when kind = 2 then 'info' when event_type = 'error' then 'error' when event_type = 'purchase' then 'warn' when event_type = 'click' and kind != 1 then 'debug' else 'info' end as level,
  case when own is null and stamp is null then 'none' when own is null then 'carried' when kind = 1 then 'assumed' else 'offset' end as time_source from dated"""
)
def stream_entries(spark, sf_dir):
    """Files of four formats that grow three times; each growth is read by a stream that goes on from the checkpoint of the last."""
    n = "event_id div 8"
    lines = [
        f"transform(sequence(0, 1 + {n} % 3), i -> if(i = 0, {LINES['plain']}, '    at com.shop.Cart.add(Cart.java:7)'))",
        f"if({n} % 2 = 0, array({LINES['postgres']}), array({LINES['postgres']}, concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS'), ' UTC [', user_id, '] app@shop DETAIL:  more')))",
        f"split({LINES['cri']}, '\n')",
        f"""if({n} % 5 = 4, array(concat('{{"level":"', {LEVEL}, '","message":"event ', event_id, ' done"}}')), array({LINES['json']}))""",
    ]
    texts = F.expr("case event_id % 4 " + " ".join(f"when {i} then {e}" for i, e in enumerate(lines)) + " end")
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(texts).alias("pos", "line"))
    kind = F.get(F.array(*[F.lit(f) for f in GROWING]), (F.col("event_id") % 4).cast("int"))
    context = [F.concat(F.lit("g"), F.col("event_id") % 8).alias("file_id"), (F.col("event_id") % 8).alias("file_idx"), F.lit("shop").alias("service"), F.lit(True).alias("service_declared"), F.lit("backend").alias("role")]
    rows = rows.select(*context, kind.alias("format"), F.lit(None).cast("string").alias("flavor"), (F.col("event_id") * 8 + F.col("pos")).alias("line_no"), "line")
    last = rows.groupBy("file_id").agg(F.max("line_no").alias("top"))
    ends = rows.groupBy(*folding.CONTEXT).agg(F.max("line_no").alias("top")).select(*folding.CONTEXT, (F.col("top") + 1).alias("line_no"), F.lit(None).cast("string").alias("line"))
    grown = rows.join(last, "file_id").withColumn("growth", F.least((F.col("line_no") * 3 / (F.col("top") + 1)).cast("int"), F.lit(2))).drop("top")
    grown = settled(grown.unionByName(ends.withColumn("growth", F.lit(2))))
    folder, shape = f"{shared_folder(spark)}/{uuid.uuid4()}", grown.drop("growth").schema
    for i in range(3):
        grown.filter(F.col("growth") == i).drop("growth").select(shape.names).write.mode("append").parquet(f"{folder}/in")
        lines = spark.readStream.schema(shape).parquet(f"{folder}/in")
        growing.append_entries(lines, folder, 2024, GROWING).trigger(availableNow=True).start().awaitTermination()
    e = growing.appended(spark, folder)
    n_lines = (F.regexp_count("raw", F.lit("\n")) + 1).cast("int").alias("n_lines")
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("stamp")
    return e.select(F.regexp_extract("message", EVENT_ID, 1).cast("bigint").alias("event_id"), n_lines, stamp, "level", "time_source")


@query("select event_id, event_id % 8 as file, 'event ' || event_id || ' of ' || user_id as line from events")
def tail_lines(spark, sf_dir):
    """Text files of events, read back in ranges of bytes."""
    tailing.register(spark)
    folder = f"{shared_folder(spark)}/{uuid.uuid4()}"
    written = table(spark, sf_dir, "events").selectExpr("cast(event_id % 8 as int) file", "concat('event ', event_id, ' of ', user_id) value")
    written.repartition("file").write.partitionBy("file").text(folder)
    read = spark.read.format("tidemark_tail").option("path", folder).option("splitBytes", 1 << 20).load()
    file = F.regexp_extract("file_id", "file=([0-9]+)/", 1).cast("bigint").alias("file")
    return read.select(F.regexp_extract("line", r"event (\d+)", 1).cast("bigint").alias("event_id"), file, "line")


def added_format() -> formats.Format:
    """A format that is not the engine's: stamp, level, service and text between bars."""
    return formats.Format(
        "bars", r"(?s)^@([^|]+)\|([^|]+)\|([^|]+)\|(.*)$", 4,
        lambda g: parsing.entry(stamp=stamps.iso(g[0]), level=levels.named(g[1]), message=parsing.with_extra(g[3]), service=g[2]), r"^@\d{4}-[^|]+\|\w+\|",
    )


@query(expected(message="'event ' || event_id || ' done' || chr(10) || 'more'"))
def parse_added_format(spark, sf_dir):
    """Lines of a format that is registered for this query, found by detection."""
    line = f"concat('@', {STAMP}, 'Z|', {LEVEL}, '|svc.', event_type, '|event ', event_id, ' done\n  more')"
    with formats.registered(added_format()):
        return compared(ingest_all(sources(spark, sf_dir, "plain", line, declared=False)).entries)


@query("""select event_type as service, user_id % 2 as role, event_id % 3 as level, cast(grouping(event_type) * 4 + grouping(user_id % 2) * 2 + grouping(event_id % 3) as integer) as grouped, count(*) as n,
  count(*) filter (event_id % 5 <> 0) as with_trace_id, count(*) filter (event_id % 7 <> 0) as with_correlation_key,
  count(distinct case when event_id % 5 <> 0 then user_id end) > 0 as traced from events group by cube(event_type, user_id % 2, event_id % 3)""")
def coverage_cube(spark, sf_dir):
    """Coverage by service, role and level and all their sums; whether a sketch has anything."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_type service", "user_id % 2 role", "event_id % 3 level", "case when event_id % 5 <> 0 then cast(user_id as string) end trace_id", "case when event_id % 7 <> 0 then map('k', 'v') else map() end correlation_keys"
    )
    return report.coverage_cube(e).withColumn("traced", F.hll_sketch_estimate("traces") > 0).drop("traces")


FORMAT_ROWS = "('plain', 'plain'), ('logfmt', 'logfmt'), ('json', 'json'), ('clf', 'clf'), ('syslog', 'syslog'), ('syslog5424', 'syslog5424'), ('postgres', 'postgres'), ('cri', 'cri')"


@query(f"select a as rendered, b as format, cast(1.0 as double) as confidence from (values {FORMAT_ROWS}) t(a, b)")
def detect_formats(spark, sf_dir):
    """What each format is found to be, over all its files: a row more for every file that is read otherwise."""
    batch = None
    for i, fmt in enumerate(LINES):
        one = sources(spark, sf_dir, fmt, declared=False).withColumn("file_idx", F.col("file_idx") * len(LINES) + i).withColumn("name", F.lit(fmt))
        batch = one if batch is None else batch.unionByName(one)
    rendered = F.array(*[F.lit(fmt) for fmt in LINES])[F.col("file_idx") % len(LINES)]
    return detection.detect(batch).select(rendered.alias("rendered"), "format", F.round("confidence", 6).alias("confidence")).distinct()


@query("""select event_id, case event_id % 7 when 0 then 'gcp' when 1 then 'datadog' when 2 then 'ecs' when 3 then 'docker' when 4 then 'bunyan' when 5 then 'pino' else 'generic' end as flavor from events""")
def json_flavor(spark, sf_dir):
    line = """case event_id % 7 when 0 then '{"insertId":"a"}' when 1 then '{"ddsource":"x","message":"m"}' when 2 then '{"@timestamp":"2024-01-01T00:00:00Z","log.level":"info"}'
      when 3 then '{"log":"x","stream":"stdout","time":"2024-01-01T00:00:00Z"}' when 4 then '{"v":0,"level":30,"msg":"m"}' when 5 then '{"level":30,"time":1}' else '{"msg":"m"}' end"""
    doc = detection.texts_of(detection.as_object(F.expr(line)))
    return table(spark, sf_dir, "events").select("event_id", detection.json_flavor(doc).alias("flavor"))


# --- producers of JSON -----------------------------------------------------------------------------------------------

MILLIS = "unix_millis(cast(ts as timestamp))"
HEX = "lpad(lower(hex(event_id + 1)), 32, '0')"
PRODUCERS = {
    "gcp": f"""concat('{{"insertId":"i', event_id, '","timestamp":"', {STAMP}, 'Z","severity":"', upper({LEVEL}), '","textPayload":"event ', event_id, '","logging.googleapis.com/trace":"projects/p/traces/', {HEX},
      '","logging.googleapis.com/spanId":"s', event_id, '","resource":{{"labels":{{"service_name":"svc.', event_type, '"}}}},"kind":"', event_type, '"}}')""",
    "datadog": f"""concat('{{"timestamp":', {MILLIS}, ',"status":"', {LEVEL}, '","message":"event ', event_id, '","service":"svc.', event_type, '","dd.trace_id":"', event_id + 7, '","dd.span_id":"', event_id + 9, '","kind":"', event_type, '","user_id":"', user_id, '"}}')""",
    "ecs": f"""concat('{{"@timestamp":"', {STAMP}, 'Z","log.level":"', {LEVEL}, '","message":"event ', event_id, '","service":{{"name":"svc.', event_type, '"}},"trace":{{"id":"', {HEX}, '"}},"span":{{"id":"s', event_id, '"}},"kind":"', event_type, '"}}')""",
    "otlp": f"""concat('{{"Timestamp":"', {MILLIS}, '000000","SeverityText":"', upper({LEVEL}), '","SeverityNumber":9,"Body":"event ', event_id, '","TraceId":"', {HEX}, '","SpanId":"s', event_id, '","Resource":{{"service":{{"name":"svc.', event_type, '"}}}},"Attributes":{{"kind":"', event_type, '"}}}}')""",
    "bunyan": f"""concat('{{"v":0,"name":"svc.', event_type, '","pid":', user_id, ',"level":', {NUMBER}, ',"time":"', {STAMP}, 'Z","msg":"event ', event_id, '","trace_id":"', {HEX}, '","span_id":"s', event_id, '","kind":"', event_type, '"}}')""",
    "pino": f"""concat('{{"level":', {NUMBER}, ',"time":', {MILLIS}, ',"pid":', user_id, ',"name":"svc.', event_type, '","msg":"event ', event_id, '","trace_id":"', {HEX}, '","span_id":"s', event_id, '","kind":"', event_type, '"}}')""",
    "docker": f"""concat('{{"log":"', upper({LEVEL}), ' [svc.', event_type, '] event ', event_id, '\\\\n","stream":"stdout","time":"', {STAMP}, 'Z"}}')""",
}


def produced(spark: SparkSession, sf_dir: str, producer: str, correlation: str | None = None) -> DataFrame:
    """Lines of one JSON producer, whose dialect is found by the keys."""
    e = ingest_all(sources(spark, sf_dir, "json", PRODUCERS[producer], declared=False)).entries
    text = lambda k: F.get_json_object(F.concat(F.lit('{"x":'), F.col("attributes")[k], F.lit("}")), "$.x")
    kind = F.coalesce(text("kind"), text("stream"))
    return e.select(
        F.regexp_extract("message", EVENT_ID, 1).cast("bigint").alias("event_id"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("stamp"), "level", "service", "message",
        "trace_id", "span_id", kind.alias("kind"), (F.col("correlation_keys")[correlation] if correlation else F.lit(None).cast("string")).alias("key"),
    )


_MICROS, _MILLIS_TEXT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '000'"
_HEX_SQL = "lpad(to_hex(event_id + 1), 32, '0')"


#: Numbers are read on the scale of tens from 25 on, in bands of four below.
NUMBERED = "case event_type when 'error' then 'critical' when 'click' then 'error' when 'purchase' then 'error' else 'warn' end"


def produced_sql(stamp: str = _MICROS, trace: str = f"lower({_HEX_SQL})", span: str = "'s' || event_id", kind: str = "event_type", key: str = "cast(null as varchar)", level: str = LEVEL) -> str:
    return f"select event_id, {stamp} as stamp, {level} as level, 'svc.' || event_type as service, 'event ' || event_id as message, {trace} as trace_id, {span} as span_id, {kind} as kind, {key} as key from events"


@query(produced_sql(key="'i' || event_id"))
def parse_gcp(spark, sf_dir):
    return produced(spark, sf_dir, "gcp", "insertId")


@query(produced_sql(_MILLIS_TEXT, "cast(event_id + 7 as varchar)", "cast(event_id + 9 as varchar)", key="cast(user_id as varchar)"))
def parse_datadog(spark, sf_dir):
    return produced(spark, sf_dir, "datadog", "user_id")


@query(produced_sql())
def parse_ecs(spark, sf_dir):
    return produced(spark, sf_dir, "ecs")


@query(produced_sql(_MILLIS_TEXT))
def parse_otlp_flat(spark, sf_dir):
    return produced(spark, sf_dir, "otlp")


@query(produced_sql(key="cast(user_id as varchar)", level=NUMBERED))
def parse_bunyan(spark, sf_dir):
    return produced(spark, sf_dir, "bunyan", "pid")


@query(produced_sql(_MILLIS_TEXT, key="cast(user_id as varchar)", level=NUMBERED))
def parse_pino(spark, sf_dir):
    return produced(spark, sf_dir, "pino", "pid")


@query(produced_sql(trace="cast(null as varchar)", span="cast(null as varchar)", kind="'stdout'"))
def parse_docker(spark, sf_dir):
    return produced(spark, sf_dir, "docker")


@query(
    """select event_id, repeat('{"a":[', event_id % 50) || '{"outer":{"db_password":"[REDACTED]","list":[1,{"token":"[REDACTED]"}],"note":"password=[REDACTED]"},"user":' || user_id || '}' || repeat(']}', event_id % 50) as nested,
    cast(3 as bigint) as n from events"""
)
def redact_nested(spark, sf_dir):
    """Values of secret names at depths from 1 to 50, objects as deep among them, strings, and their count."""
    deep = """concat(repeat('{"b":', event_id % 50), '{"x":"s', event_id, '","y":[', user_id, ']}', repeat('}', event_id % 50))"""
    value = f"""concat(repeat('{{"a":[', event_id % 50), '{{"outer":{{"db_password":"p', event_id, '","list":[1,{{"token":', {deep}, '}}],"note":"password=q', event_id, '"}},"user":', user_id, '}}', repeat(']}}', event_id % 50))"""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "'m' message", "'r' raw", f"map('detail', {value}) attributes")
    r = redact.redact_entries(e)
    return r.select("event_id", F.col("attributes")["detail"].alias("nested"), F.size("redactions").cast("bigint").alias("n"))


WORDS = "array('Warning', 'ERR', 'notice', 'panic', 'crit', 'emerg', 'nothing', 'verbose')"


@query("select event_id, ['warn', 'error', 'info', 'fatal', 'critical', 'fatal', 'info', 'trace'][event_id % 8 + 1] as level from events")
def level_alias(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", levels.named(F.expr(f"{WORDS}[event_id % 8]")).alias("level"))


@query("""select event_id, case when n <= 0 then 'info' when n <= 4 then 'trace' when n <= 8 then 'debug' when n <= 12 then 'info' when n <= 16 then 'warn' when n <= 20 then 'error' when n <= 24 then 'fatal'
  when n >= 60 then 'fatal' when n >= 50 then 'critical' when n >= 40 then 'error' when n >= 30 then 'warn' else 'info' end as level from (select event_id, event_id % 70 - 2 as n from events)""")
def level_number(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", levels.of_number(F.col("event_id") % 70 - 2).alias("level"))


@query("select event_id, cast(epoch_us(ts) // 1000000 * 1000000 as bigint) as us from events")
def epoch_units(spark, sf_dir):
    """Seconds, milli-, micro- and nanoseconds give one instant."""
    e = table(spark, sf_dir, "events").withColumn("s", F.expr("unix_micros(cast(ts as timestamp)) div 1000000"))
    value = F.expr("concat(s, array('', '000', '000000', '000000000')[event_id % 4])")
    return e.select("event_id", F.unix_micros(stamps.epoch(value)["ts"].cast("timestamp")).alias("us"))


@query("select event_id, ['app', 'a.log', 'a', 'x.json', 'unknown'][event_id % 5 + 1] as stem from events")
def service_stem(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", file_stem(F.expr("array('d/app.log', 'a.log.gz', 'a.gz', 'x.json.gz', 'p/.log')[event_id % 5]")).alias("stem"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as local, case event_id % 3 when 0 then 0 when 1 then 19800 else -14400 end as offset_s from events")
def iso_offsets(spark, sf_dir):
    text = F.expr(f"concat({STAMP}, array('Z', '+05:30', '-0400')[event_id % 3])")
    return table(spark, sf_dir, "events").withColumn("s", stamps.iso(text)).select("event_id", F.date_format("s.ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("local"), F.col("s.offset_s").alias("offset_s"))


def timed(spark: SparkSession, sf_dir: str, missing: str = "false", zone: str = "cast(null as string)", offset: str = "cast(null as int)") -> DataFrame:
    """Events as entries before time resolution; those for which ``missing`` holds have no stamp."""
    return table(spark, sf_dir, "events").selectExpr(
        "cast(event_id % 8 as int) file_idx", "concat('f', event_id % 8) file_id", "cast(event_id as int) line_no", "0 seq", f"case when not ({missing}) then ts end ts", f"{offset} offset_s", f"{zone} timezone", "0 offset_seconds", "event_id"
    )


@query("select event_id, epoch_us((ts at time zone (case event_id % 2 when 0 then 'America/New_York' else 'Asia/Kolkata' end)) at time zone 'UTC') as us, 'zone' as time_source from events")
def tz_resolve(spark, sf_dir):
    r = normalize.resolve(timed(spark, sf_dir, zone="case event_id % 2 when 0 then 'America/New_York' else 'Asia/Kolkata' end"))
    return r.select("event_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), "time_source")


CARRIED = """with e as (select event_id, event_id % 8 as f, case when event_id % 5 <> 0 and event_id >= 16 then ts end as own from events)
select event_id, epoch_us(coalesce(last_value(own ignore nulls) over (partition by f order by event_id rows unbounded preceding), min(own) over (partition by f))) as us,
  case when own is null then 'carried' else 'assumed' end as time_source from e"""


@query(CARRIED)
def carry_forward(spark, sf_dir):
    """Missing stamps carry the one before, those at the head of a file its minimum."""
    r = normalize.resolve(timed(spark, sf_dir, "event_id % 5 = 0 or event_id < 16"))
    return r.select("event_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), "time_source")


SKEWED = """with w as (select event_id % 8 as f, min(ts) + interval (event_id % 8 * 90) day as a, max(ts) + interval (event_id % 8 * 90) day as b from events group by 1, event_id % 8),
g as (select x.f, min(greatest(epoch_us(y.a) - epoch_us(x.b), epoch_us(x.a) - epoch_us(y.b))) / 1e6 as gap from w x join w y on x.f <> y.f group by x.f)
select cast(f as integer) as file_idx, gap > 120 as suspected from g"""


@query(SKEWED)
def skew_report(spark, sf_dir):
    clocks = normalize.file_clocks(normalize.resolve(timed(spark, sf_dir).withColumn("ts", F.expr("ts + make_dt_interval(cast(event_id % 8 as int) * 90)"))))
    return normalize.detect_skew(clocks).select("file_idx", (F.col("gap_seconds") > 120).alias("suspected"))


#: Blocks of a thousand lines, so that small tables have many.
SMALL_BLOCKS = (10, 20, 63)


@query("select event_id, cast(2 + event_id % 3 as integer) as n_lines, event_id * 5 + 1 as line_no from events")
def fold_blocks(spark, sf_dir):
    """Stack traces of one file of all events, folded in blocks of lines."""
    first = "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z ERROR event ', event_id, ' failed')"
    lines = table(spark, sf_dir, "events").selectExpr("event_id", f"{first} first", "explode(sequence(0, cast(1 + event_id % 3 as int))) k")
    fixed = {"file_id": "f0", "service": "app", "role": "backend", "format": "plain", "flavor": None}
    lines = lines.withColumns({c: F.lit(v).cast("string") for c, v in fixed.items()}).withColumns({"file_idx": F.lit(0), "service_declared": F.lit(False)})
    lines = lines.withColumns({"line_no": F.col("event_id") * 5 + F.col("k") + 1, "line": F.when(F.col("k") == 0, F.col("first")).otherwise("    at com.shop.Cart.add(Cart.java:7)")})
    e = folding.fold_blocks(lines.select(*folding.CONTEXT, "line_no", "line"), {"plain"}, SMALL_BLOCKS)
    return e.select(F.regexp_extract("line", EVENT_ID, 1).cast("bigint").alias("event_id"), (F.size("extra") + 1).alias("n_lines"), "line_no")


@query(
    """with e as (select event_id, case when event_id % 4000 >= 2500 or event_id % 7 = 1 then ts end as own from events)
select event_id, epoch_us(coalesce(last_value(own ignore nulls) over (order by event_id rows unbounded preceding), min(own) over ())) as us, case when own is null then 'carried' else 'assumed' end as time_source from e"""
)
def carry_blocks(spark, sf_dir):
    """One file of all events; stamps are carried over many blocks, and its head takes its earliest stamp."""
    one = timed(spark, sf_dir, "not (event_id % 4000 >= 2500 or event_id % 7 = 1)").withColumns({"file_idx": F.lit(0), "file_id": F.lit("f0")})
    r = normalize.resolve(one, SMALL_BLOCKS)
    return r.select("event_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), "time_source")


@query(
    """with w as (select user_id as f, min(ts) + interval (user_id % 400) day as a, min(ts) + interval (user_id % 400) day + interval (user_id % 50) minute as b from events group by user_id),
g as (select x.f, min(greatest(epoch_us(y.a) - epoch_us(x.b), epoch_us(x.a) - epoch_us(y.b))) as gap from w x join w y on x.f <> y.f group by x.f)
select f as file_idx, cast(greatest(gap, 0) as bigint) as gap_us, gap > 120000000 as suspected from g"""
)
def skew_many_files(spark, sf_dir):
    """A file for each user; every one is compared with the nearest of all others."""
    clocks = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("m"))
    clocks = clocks.selectExpr("user_id file_idx", "concat('f', user_id) file_id", "m + make_dt_interval(cast(user_id % 400 as int)) first", "m + make_dt_interval(cast(user_id % 400 as int), 0, cast(user_id % 50 as int)) last")
    found = normalize.skew_of_many(settled(clocks))
    return found.select("file_idx", F.round(F.col("gap_seconds") * 1e6).cast("bigint").alias("gap_us"), F.col("skew_warning").isNotNull().alias("suspected"))


# --- templates and flows ---------------------------------------------------------------------------------------------

LETTERS = "translate(cast(user_id as string), '0123456789', 'abcdefghij')"
TALK = f"""case event_id % 3 when 0 then 'job ' || {LETTERS} || ' ' || event_type || ' took ' || event_id || 'ms' when 1 then 'login of ' || {LETTERS} || ' from region ' || substr('nesw', cast(1 + event_id % 4 as int), 1)
  else {LETTERS} || ' closed session s' || event_id end"""
SPOKEN_BY = "case event_id % 2 when 0 then 'web' else 'db' end"


def _templates_sql(depth: int = 3, most: int = 20) -> str:
    varying = templating.VARYING.replace("'", "''")
    steps = [f"""p0 as (select {SPOKEN_BY} service, trim(regexp_replace({TALK}, '{varying}', '{templating.ANY}', 'g')) pattern, count(*) n, min(ts) a, max(ts) b from events group by 1, 2),
t0 as (select *, string_split(pattern, ' ') tk, service || ' ' || len(tk) node, []::varchar[] path from p0)"""]
    for i in range(depth):
        steps.append(f"""w{i} as (select node from t{i} where len(tk) > {i} group by node having count(distinct tk[{i + 1}]) > {most}),
s{i} as (select t{i}.*, case when len(tk) > {i} then case when w{i}.node is null then tk[{i + 1}] else '{templating.ANY}' end end step from t{i} left join w{i} using (node)),
t{i + 1} as (select * exclude (node, path, step), case when step is null then node else node || ' ' || step end node, case when step is null then path else list_append(path, step) end path from s{i})""")
    steps.append(f"""places as (select node, unnest(range({depth + 1}, len(tk) + 1)) i, tk from t{depth}),
wide as (select node, list(i) ws from (select node, i from places group by node, i having count(distinct tk[i]) > {most}) group by node),
done as (select t.*, array_to_string(list_concat(path, list_transform(range({depth + 1}, len(tk) + 1), lambda i: case when list_contains(coalesce(ws, []), i) then '{templating.ANY}' else tk[i] end)), ' ') template from t{depth} t left join wide using (node))""")
    return f"with {', '.join(steps)}\nselect service, template, sum(n)::bigint n, epoch_us(min(a)) first_us, epoch_us(max(b)) last_us from done group by service, template"


@query(_templates_sql())
def log_templates(spark, sf_dir):
    """Templates of messages by service, with counts, first and last time."""
    e = table(spark, sf_dir, "events").selectExpr(f"{SPOKEN_BY} service", f"{TALK} message", "cast(ts as timestamp) timestamp")
    us = lambda c: F.unix_micros(c).alias(f"{c}_us")
    return templating.templates(templating.mine(e)).select("service", "template", F.col("n"), us("first"), us("last"))


#: A request of five events; some name their user, and three in ten requests name one tenant.
TIES = {"request_id": "cast(event_id div 5 as string)", "user_id": "case when event_id % 40 = 0 then cast(user_id as string) end", "tenant": "case when event_id div 5 % 10 < 3 then 'x' end"}


@query(
    """with recursive e as (select event_id, list_sort(list_filter(['request_id=' || event_id // 5, case when event_id % 40 = 0 then 'user_id=' || user_id end, case when event_id // 5 % 10 < 3 then 'tenant=x' end], lambda x: x is not null)) ks from events),
ties as (select distinct ks[1] u, unnest(ks) v from e), sides as (select u, v from ties union select v, u from ties),
reached(x, y) as (select u, u from sides union select r.x, s.v from reached r join sides s on r.y = s.u),
labels as (select x, min(y) label from reached group by x)
select event_id, substr(sha256(label), 1, 16) flow_id from e join labels on ks[1] = x"""
)
def flow_ids(spark, sf_dir):
    """Events that share requests, users or the tenant, directly or through others."""
    keys = ", ".join(f"'{k}', coalesce({v}, '')" for k, v in TIES.items())
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"map({keys}) correlation_keys", "cast(null as string) trace_id", "'f0' file_id", "event_id line_no", "0 seq", "cast(null as string) flow_id")
    return flowing.with_flow_ids(e, flowing.flow_labels(e)).select("event_id", "flow_id")


BY_USER = ("service", "user")


def occurred(spark: SparkSession, sf_dir: str, user: str = "user_id % 4") -> DataFrame:
    return rhythm.occurrences(table(spark, sf_dir, "events").selectExpr("event_type service", f"cast({user} as string) user", "ts timestamp"), BY_USER)


GAPS_SQL = "with g as (select event_type service, cast(user_id % 4 as varchar) u, epoch_us(ts) us, epoch_us(ts) - lag(epoch_us(ts)) over (partition by event_type, user_id % 4 order by ts) gap from events)"


@query(f"""{GAPS_SQL}, r as (select *, row_number() over (partition by service, u order by gap nulls last) i, count(gap) over (partition by service, u) m from g)
select service, u as "user", count(*) n, min(us) "first", max(us) "last", min(gap) shortest, min(gap) filter (i >= ceil(0.1 * m)) p10, min(gap) filter (i >= ceil(0.5 * m)) p50, min(gap) filter (i >= ceil(0.9 * m)) p90, max(gap) longest from r group by 1, 2""")
def cadence(spark, sf_dir):
    """How often each kind of event of a group of users occurs."""
    return rhythm.cadence(rhythm.gaps(occurred(spark, sf_dir), BY_USER), BY_USER)


@query(f"""{GAPS_SQL}, s as (select *, sum(case when gap is null or gap > 3600000000 then 1 else 0 end) over (partition by service, u order by us) run from g)
select service, u as "user", min(us) "start", max(us) "end", count(*) n from s group by service, u, run having count(*) >= 3""")
def event_bursts(spark, sf_dir):
    """Runs of at least three events of a kind and group with no hour between."""
    return rhythm.bursts(rhythm.gaps(occurred(spark, sf_dir), BY_USER), 3_600_000_000, 3, BY_USER)


@query("""with t as (select event_type || '/' || (user_id % 4) k, epoch_us(ts) // 60000000 slot, min(epoch_us(ts)) us from events group by 1, 2),
c as (select k, count(*) "of" from t group by k),
p as (select a.k ak, b.k bk, a.us, min(b.us - a.us) // 1000000 * 1000000 lag from t a join t b on a.k <> b.k and b.us > a.us and b.us <= a.us + 1800000000 group by all)
select string_split(ak, '/')[1] a_service, string_split(ak, '/')[2] a_user, string_split(bk, '/')[1] b_service, string_split(bk, '/')[2] b_user, count(*) n, any_value("of") "of", median(lag) median_lag from p join c on ak = k group by ak, bk""")
def event_followers(spark, sf_dir):
    """Which kind and group comes within half an hour after another, how often and how soon."""
    return rhythm.followers(occurred(spark, sf_dir), 1_800_000_000, 60_000_000, 1_000_000, BY_USER)


@query("select event_id, row_number() over (order by ts nulls first, 'f' || (event_id % 8), event_id) as place from events order by place limit 200")
def timeline_head(spark, sf_dir):
    r = normalize.resolve(timed(spark, sf_dir))
    head = normalize.timeline(r).limit(200).select("event_id", "timestamp", "file_id", "line_no")
    place = F.expr("row_number() over (order by timestamp nulls first, file_id, line_no)").cast("bigint")
    return head.select("event_id", place.alias("place"))


@query("select event_id from (select event_id, row_number() over (order by event_id % 8, event_id) as n from events) where n <= 3000")
def line_budget(spark, sf_dir):
    return normalize.within_budget(timed(spark, sf_dir), 3000).select("event_id")


CARD_SQL = r"\b(?:\d[ -]?){12,18}\d\b"
KV_SQL = "(?i:\\b(?:" + "|".join(redact.SECRET_NAMES) + r""")\s*[=:]\s*(?:Bearer\s+|Basic\s+|Token\s+)?(?:"[^"]*"|''[^'']*''|[^\s,;&)}\]]+))"""


@query(
    f"""with hits as (select doc_id, len(regexp_extract_all(text, '{KV_SQL}')) as kv, len(regexp_extract_all(text, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b')) as ip from documents)
select doc_id, cast(kv as bigint) as n_secret, cast(ip as bigint) as n_ip from hits where kv + ip > 0"""
)
def redact_counts(spark, sf_dir):
    """Rules that fire per document, with addresses asked for and cards and e-mail off."""
    policy = redact.Policy(redact_ips=True, disabled=frozenset({"card", "email"}))
    r = table(spark, sf_dir, "documents").select("doc_id", redact.redacted(F.col("text"), policy).alias("r"))
    count = lambda rule: F.size(F.filter("r.rules", lambda x: x == rule)).cast("bigint")
    return r.select("doc_id", count("secret_kv").alias("n_secret"), count("ip").alias("n_ip")).filter("n_secret + n_ip > 0")


@query(r"select doc_id, sha256(regexp_replace(text, '\b[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED:email]', 'g')) as clean from documents")
def redact_emails(spark, sf_dir):
    policy = redact.Policy(disabled=frozenset(set(redact.RULES) - {"email"}))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(redact.redacted(F.col("text"), policy)["text"], 256).alias("clean"))


LUHN = """with d as (select event_id, lpad(cast(event_id * 7919 % 1000000007 * 1000003 + 4 as varchar), 16, '4') as digits from events),
x as (select event_id, digits, unnest(range(1, 17)) as i from d)
select event_id, sum(case when (16 - i) % 2 = 0 then ascii(digits[i]) - 48 else (ascii(digits[i]) - 48) * 2 - case when digits[i] > '4' then 9 else 0 end end) % 10 = 0 as valid from x group by event_id"""


@query(LUHN)
def card_luhn(spark, sf_dir):
    digits = F.expr("lpad(cast(event_id * 7919 % 1000000007 * 1000003 + 4 as string), 16, '4')")
    return table(spark, sf_dir, "events").select("event_id", redact.luhn(digits).alias("valid"))


#: Every fifth line has no stamp, every third no trace, every seventh no user, and errors carry a password.
UNEVEN = f"""concat(case when event_id % 5 = 0 then '' else concat('ts=', {STAMP}, 'Z ') end, 'level=', {LEVEL}, ' msg="event ', event_id, ' by u', user_id, '@shop.example" svc=svc.', event_type,
  case when event_id % 7 = 0 then '' else concat(' user_id=', user_id) end, case when event_id % 3 = 0 then '' else concat(' trace_id=t', event_id) end, case when event_type = 'error' then concat(' password=p', event_id) else '' end)"""


def uneven(spark: SparkSession, sf_dir: str) -> Ingested:
    return ingest_all(sources(spark, sf_dir, "logfmt", UNEVEN))


@query(
    """select cast(event_id % 8 as integer) as file_idx, 'logfmt' as format, count(*) as entry_count, count(*) filter (event_id % 3 <> 0) as with_trace_id, count(*) filter (event_id % 5 = 0) as unresolved,
  cast(0 as bigint) as dropped, cast(count(*) as integer) as line_count from events group by 1"""
)
def file_report(spark, sf_dir):
    files = uneven(spark, sf_dir).files.groupBy((F.col("file_idx") % FILES).cast("int").alias("file_idx"), "format")
    counts = [F.sum(c).cast("bigint").alias(c) for c in ("entry_count", "with_trace_id", "unresolved", "dropped")]
    return files.agg(*counts, F.sum("line_count").cast("int").alias("line_count"))


@query("select count(*) as entry_count, count(*) filter (event_id % 3 <> 0) / count(*) as trace_coverage, count(*) filter (event_id % 7 <> 0) / count(*) as correlation_coverage from events")
def preview_summary(spark, sf_dir):
    return uneven(spark, sf_dir).coverage.select("entry_count", "trace_coverage", "correlation_coverage")


@query("select 'email' as rule, count(*) as n from events union all select 'secret_kv', count(*) from events where event_type = 'error'")
def redaction_report(spark, sf_dir):
    """What redaction replaced in messages and attributes, by rule."""
    return uneven(spark, sf_dir).redactions


LEVEL_COUNTS = f"""with t as (select event_id, event_id % 8 as f, {LEVEL} as level, event_type, user_id, case when event_id % 5 <> 0 then ts end as own from events),
r as (select *, epoch_us(coalesce(last_value(own ignore nulls) over (partition by f order by event_id rows unbounded preceding), min(own) over (partition by f))) as us from t)
select level, count(*) as n, count(*) as touched, cast(sum(us // 1000000) as bigint) as seconds, cast(sum(length('event ' || event_id || ' by [REDACTED:email]')) as bigint) as message_chars,
  cast(sum(case when event_id % 7 = 0 then 0 else length(user_id::varchar) end + case when event_type = 'error' then 12 else 0 end) as bigint) as attribute_chars from r group by level"""


@query(LEVEL_COUNTS)
def level_counts(spark, sf_dir):
    """Lines to detected format, entries, resolved time and redaction; counts per level of all that these make."""
    e = ingest_lines(long_files(spark, sf_dir, UNEVEN), year=2024, role="backend").entries  # stamps are carried through a file, so none is cut
    values = F.aggregate(F.map_values("attributes"), F.lit(0), lambda n, v: n + F.length(v))
    return e.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("touched").alias("touched"), F.sum(F.floor(F.unix_micros(F.col("timestamp").cast("timestamp")) / 1_000_000)).cast("bigint").alias("seconds"),
        F.sum(F.length("message")).alias("message_chars"), F.sum(values).cast("bigint").alias("attribute_chars"),
    )


RENDERED = f"""strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when strftime(ts, '%f') <> '000000' then '.' || strftime(ts, '%f') else '' end || '+00:00 ' || rpad(upper({LEVEL}), 8, ' ') || ' svc.' || event_type || ': event ' || event_id || ' done'"""


@query(f"select event_id, {RENDERED} as rendered from events")
def prompt_render(spark, sf_dir):
    e = prompts.rendered(read(spark, sf_dir, "logfmt").entries)
    return e.select(F.regexp_extract("message", EVENT_ID, 1).cast("bigint").alias("event_id"), "rendered")


@query(
    f"""with t as (select event_id % 8 as f, string_agg({RENDERED}, chr(10) order by ts, event_id) as body from events group by 1)
select 'f' || f as file_id, case when length(body) <= 2000 then body else left(body, 1000) || chr(10) || chr(10) || '… [' || format('{{:,}}', length(body) - 2000) || ' characters of the middle omitted] …' || chr(10) || chr(10) || right(body, 1000) end as prompt from t"""
)
def prompt_trim(spark, sf_dir):
    e = ingest_lines(long_files(spark, sf_dir, LINES["logfmt"]), year=2024, role="backend", format="logfmt").entries
    return prompts.transcript(e, "file_id", max_chars=2000)


@query("select doc_id, cast(round_even(length(text) / 3.4, 0) as bigint) as log_tokens, cast(round_even(length(text) / 3.9, 0) as bigint) as prose_tokens from documents")
def token_estimates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", prompts.log_tokens(F.length("text")).alias("log_tokens"), prompts.prose_tokens(F.length("text")).alias("prose_tokens"))


CHARS = {"parser": 390, "pattern": 780, "rootcause": 1170, "predictor": 1560}
HEADERS = dict.fromkeys(CHARS, 39)
STAGE_SQL = """with s as (select event_id, event_id % 90000 as logs from events), v as (select event_id, logs, cast(least(round_even(600 + logs * 0.05, 0), 4000) as bigint) as p from s),
r as (select event_id, 'parser' as stage, 100 + 20 + logs + 12 as i, p as o from v union all select event_id, 'pattern', 200 + 10 + p + 12, 1000 from v
union all select event_id, 'rootcause', 300 + 20 + p + 1000 + 12, 1300 from v union all select event_id, 'predictor', 400 + 30 + p + 2300 + 12, 1200 from v)
select event_id, stage, cast(i as bigint) as input_tokens, cast(o + round_even(o * 1.2, 0) as bigint) as output_tokens, cast(round_even(o * 1.2, 0) as bigint) as thinking_tokens from r"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 90000).alias("log_tokens"))
    return cost.forecast(samples, "event_id", system_chars=CHARS, wrapper_chars=78, header_chars=HEADERS)


@query(STAGE_SQL)
def cost_stages(spark, sf_dir):
    return forecasts(spark, sf_dir).drop("position")


MODELS = ", ".join(f"('{m}', {i}::double, {o}::double, {c}, {r}::double)" for m, _, i, o, c, r in cost.CATALOG)


@query(
    f"""with st as ({STAGE_SQL}), t as (select event_id, sum(input_tokens) as i, sum(output_tokens) as o, max(input_tokens + output_tokens) as big from st group by event_id),
m(model, ir, orr, ctx, ratio) as (values {MODELS}), x as (select event_id, model, cast(round_even(i * ratio, 0) as bigint) as ti, cast(round_even(o * ratio, 0) as bigint) as o2, ir, orr, round_even(big * ratio, 0) <= ctx as fits from t, m)
select event_id, model, ti as input_tokens, o2 as output_tokens, ti * ir / 1e6 + o2 * orr / 1e6 as total_usd, fits as fits_context from x"""
)
def cost_catalog(spark, sf_dir):
    """Prices of each forecast by model."""
    return cost.priced(cost.totals(forecasts(spark, sf_dir), "event_id"), "event_id").select("event_id", "model", "input_tokens", "output_tokens", "total_usd", "fits_context")


@query(
    f"""with st as ({STAGE_SQL}), t as (select event_id, sum(input_tokens) as i, sum(output_tokens) as o, max(input_tokens + output_tokens) as big from st group by event_id),
m(model, ir, orr, ctx, ratio) as (values {MODELS}), x as (select event_id, model, round_even(i * ratio, 0) * ir / 1e6 + round_even(o * ratio, 0) * orr / 1e6 as usd, round_even(big * ratio, 0) <= ctx as fits from t, m),
b as (select event_id, min(struct_pack(usd := usd, model := model)) filter (fits) as b, max(usd) filter (model = '{cost.CURRENT}') as cur from x group by event_id)
select event_id, b.model as model, b.usd as total_usd, case when b.model = '{cost.CURRENT}' or cur = 0 or b.usd = 0 then '' when cur / b.usd >= 10 then printf('%.0f× cheaper', cur / b.usd)
  when cur / b.usd >= 1 then printf('%.1f× cheaper', cur / b.usd) else printf('%.1f× dearer', b.usd / cur) end as relative from b where b is not null"""
)
def cost_cheapest(spark, sf_dir):
    return cost.cheapest(cost.priced(cost.totals(forecasts(spark, sf_dir), "event_id"), "event_id"), "event_id")


@query(
    f"""with m(model, ir, orr, ctx, ratio) as (values {MODELS}), u as (select event_id, ['gpt-5', 'deepseek-v3', 'claude-opus-5', 'other'][event_id % 4 + 1] as model, event_id % 5000 * 100000 as i, event_id % 700 * 100000 as o, event_id % 90 * 100000 as r, event_id % 40 * 100000 as w from events)
select event_id, model, round(((i + r * 0.1::double + w * 1.25::double) * ratio * ir + o * ratio * orr) / 1e6, 6) as usd from u left join m using (model)"""
)
def actual_cost(spark, sf_dir):
    u = table(spark, sf_dir, "events").selectExpr("event_id", "array('gpt-5', 'deepseek-v3', 'claude-opus-5', 'other')[event_id % 4] model", "event_id % 5000 * 100000 input_tokens", "event_id % 700 * 100000 output_tokens", "event_id % 90 * 100000 cache_read_tokens", "event_id % 40 * 100000 cache_write_tokens")
    return cost.actual_cost(u).select("event_id", "model", F.col("cost_usd").cast("double").alias("usd"))


@query(
    """select event_id, position, title, severity, confidence, eta from (
select event_id, 0 as position, 'bug ' || event_id as title, case event_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as severity, cast(least(100, event_id % 150) as integer) as confidence, case when event_id % 2 = 0 then '2h' end as eta from events
union all select event_id, 1, 'second', 'medium', 0, null from events)"""
)
def prediction_rows(spark, sf_dir):
    output = """concat('{"predictions":[{"title":" bug ', event_id, ' ","severity":"', array('HIGH', 'odd', ' low ')[event_id % 3], '","confidence":', event_id % 150, ',"eta":"', case when event_id % 2 = 0 then '2h' else '' end, '"},{"title":"  "},{"title":"second","severity":"medium","confidence":-4}]}')"""
    return analyses.prediction_rows(table(spark, sf_dir, "events").select("event_id", F.expr(output).alias("output")), "event_id").select("event_id", "position", "title", "severity", "confidence", "eta")


def stored_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey analysis_id", "o_custkey user_id", "o_orderdate created_at", "o_orderstatus status")


@query("select o_orderkey as analysis_id, o_orderstatus as status from orders where o_custkey = 7 order by o_orderdate desc, o_orderkey desc limit 20")
def recent_analyses(spark, sf_dir):
    return analyses.recent(stored_analyses(spark, sf_dir), F.lit(7), 20).select("analysis_id", "status")


@query("select o_orderkey as analysis_id, count(l_orderkey) as n_predictions, coalesce(min(l_linenumber), -1) as first_position from orders left join lineitem on l_orderkey = o_orderkey where o_orderkey = (select min(l_orderkey) from lineitem) group by 1")
def analysis_detail(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    children = lines.selectExpr("l_orderkey analysis_id", "l_linenumber position", "'t' title", "'low' severity", "1 confidence")
    a = stored_analyses(spark, sf_dir)
    chosen = lines.agg(F.min("l_orderkey").alias("id")).first()[0]
    owner = a.filter(F.col("analysis_id") == chosen).select("user_id").first()[0]
    d = analyses.detail(a, children, F.lit(owner), F.lit(chosen))
    return d.select("analysis_id", F.size("predictions").cast("bigint").alias("n_predictions"), F.coalesce(F.col("predictions")[0]["position"], F.lit(-1)).alias("first_position"))


@query(
    """select l_orderkey as analysis_id, case when count(*) % 3 = 0 then 'failed' else 'done' end as status, string_agg(distinct 'agent ' || l_linenumber, ',' order by 'agent ' || l_linenumber) as agents,
  case when count(*) % 3 = 0 then 'lines dropped' end as note from lineitem group by 1"""
)
def analysis_status(spark, sf_dir):
    """An analysis for each order: running, an agent for each line, and its end."""
    lines = table(spark, sf_dir, "lineitem")
    at = "timestamp '2024-01-01' + make_dt_interval(0, 0, 0, {})"
    agents = lines.selectExpr("l_orderkey analysis_id", at.format("l_linenumber") + " at", "'running' status", "concat('agent ', l_linenumber) agent", "cast(null as string) note")
    ends = lines.groupBy("l_orderkey").count().selectExpr(
        "l_orderkey analysis_id", at.format("1000") + " at", "case when count % 3 = 0 then 'failed' else 'done' end status", "cast(null as string) agent", "case when count % 3 = 0 then 'lines dropped' end note"
    )
    return analyses.status_of(agents.unionByName(ends)).select("analysis_id", "status", F.array_join("agents", ",").alias("agents"), "note")


@query(
    """select event_id, case when u = 0 then '$0' when u < 0.01 then printf('$%.4f', u) when u < 1 then printf('$%.3f', u) else printf('$%.2f', u) end as usd,
  case when n < 1000 then n::varchar when n < 10000 then printf('%.1fk', n / 1000) else printf('%.0fk', n / 1000) end as tokens from (select event_id, event_id * 0.00037013::double as u, event_id * 100 + 13 as n from events)"""
)
def display_formats(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", cost.usd_text(F.col("event_id") * F.lit(0.00037013)).alias("usd"), cost.tokens_text(F.col("event_id") * 100 + 13).alias("tokens"))
