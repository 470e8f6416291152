"""Events to entries: one projection per kind of line, chosen by a CASE, over events of all formats at once.

The stages below only add columns, so the eight formats share one scan and one fold. Attribute values are JSON texts.
Where a line does not have the shape of its file's format it is read as plain text; no line is lost.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import levels, stamps
from tidemark.functions.text import empty_map, groups, json_plain, json_string, let, map_of, over, scalar_json, strip
from tidemark.operators import fold
from tidemark.operators.detect import texts_of, tree_of
from tidemark.formats import ADDED
from tidemark.schema import FORMATS

# Key names by field, producer and format; words that are not loggers.
GENERIC = {
    "timestamp": "timestamp @timestamp time ts eventTime asctime Timestamp",
    "level": "level severity levelname log.level lvl status SeverityText severityText",
    "message": "message msg body Body event short_message text log",
    "trace_id": "trace_id traceId TraceId trace.id dd.trace_id",
    "span_id": "span_id spanId SpanId span.id dd.span_id",
    "parent_span_id": "parent_span_id parentSpanId ParentSpanId parent_id",
    "service": "service service.name serviceName dd.service component logger logger_name name",
}
FLAVORS = {
    "gcp": {
        "timestamp": "timestamp receiveTimestamp",
        "level": "severity",
        "message": "textPayload message jsonPayload.message jsonPayload.msg protoPayload.status.message",
        "trace_id": "logging.googleapis.com/trace trace",
        "span_id": "logging.googleapis.com/spanId spanId",
        "service": "resource.labels.service_name resource.labels.container_name resource.labels.function_name resource.labels.module_id logging.googleapis.com/sourceLocation.file",
    },
    "datadog": {"level": "status level syslog.severity", "trace_id": "dd.trace_id trace_id", "span_id": "dd.span_id span_id", "service": "service dd.service ddsource"},
    "ecs": {"timestamp": "@timestamp", "level": "log.level level", "trace_id": "trace.id", "span_id": "span.id", "parent_span_id": "parent.id", "service": "service.name service"},
    "otlp": {
        "timestamp": "Timestamp timestamp timeUnixNano observedTimeUnixNano",
        "level": "SeverityText severityText",
        "message": "Body body",
        "trace_id": "TraceId traceId trace_id",
        "span_id": "SpanId spanId span_id",
        "service": "Resource.service.name resource.service.name",
    },
    "bunyan": {"message": "msg", "service": "name"},
    "pino": {"message": "msg", "service": "name"},
}
SEVERITY_NUMBERS = "SeverityNumber severityNumber severity_number"
JSON_KEYS = "request_id requestId req_id reqId correlation_id correlationId session_id sessionId user_id userId transaction_id transactionId insertId pid thread thread_name"
LOGFMT = {
    "time": "ts time timestamp t @timestamp",
    "level": "level lvl severity sev",
    "message": "msg message event text",
    "service": "service svc component logger caller app name",
    "trace": "trace_id traceid trace dd.trace_id",
    "span": "span_id spanid span dd.span_id",
}
LOGFMT_KEYS = "request_id requestid req_id correlation_id session_id user_id pid org_id tenant"
SD_KEYS = "request_id requestid req_id correlation_id session_id user_id"
NOT_LOGGER = "TRACE DEBUG INFO WARN WARNING ERROR ERR CRIT CRITICAL FATAL PANIC NOTICE LOG"
LOGGER = r"[\[(]([\w.\-/:]{2,64})[\])]"
DURATION = r"\b(?:rt|request_time|duration|took)[=:]?\s*(\d+\.?\d*)"
REQUEST_ID = r'(?i)\b(?:request[_-]?id|req[_-]?id|x[_-]request[_-]id|trace[_-]?id|correlation[_-]?id)[=:]?\s*"?([A-Za-z0-9._-]{6,128})"?'
BARE_ID = r"\b([0-9a-f]{32}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\b"
SD_ELEMENT = r'\[([^\s\]]+)((?:\s+[\w.@-]+="(?:[^"\\]|\\.)*")*)\]'
SD_PARAM = r'([\w.@-]+)="((?:[^"\\]|\\.)*)"'

DOTTED = sorted({k for m in [GENERIC, *FLAVORS.values()] for keys in m.values() for k in keys.split() if "." in k and "/" not in k})
SHAPES = {"clf": (fold.CLF_LINE, 9), "postgres": (fold.POSTGRES_LINE, 7), "syslog5424": (fold.SYSLOG5424_LINE, 7), "syslog": (fold.SYSLOG_LINE, 6)}
RECORD = "array<struct<doc:string,resource:map<string,string>,scope:map<string,string>>>"
FIELDS = "stamp level message service trace_id span_id parent_span_id attributes correlation_keys".split()


def filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def last_wins(entries: Column) -> Column:
    """A map of (key, value) structs; of equal keys the last holds."""

    def chosen(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda x: x.key)
        last = F.filter(pairs, lambda x, i: x.key.isNotNull() & ~F.array_contains(F.slice(keys, i + 2, F.size(pairs)), x.key))
        simple = (F.size(F.array_distinct(keys)) == F.size(pairs)) & ~F.exists(keys, lambda k: k.isNull())
        return F.map_from_entries(F.when(simple, pairs).otherwise(last))

    return let(entries, chosen)


def with_extra(message: Column) -> Column:
    more = F.array_join(F.transform("extra", lambda x: strip(x)), "\n")
    return strip(F.when(F.size("extra") > 0, F.concat(message, F.lit("\n"), more)).otherwise(message))


def unwrap(v: str, depth: int = 2) -> str:
    """SQL for the JSON text inside a typed single-key value ``v``; lists and maps of them down to ``depth``."""
    scalar = r"""^\{"(?:stringValue|boolValue|doubleValue|bytesValue)":(.*)\}$"""
    whole = r"""^\{"intValue":"?(-?\d+)"?\}$"""
    cases = f"WHEN {v} RLIKE r'{scalar}' THEN regexp_extract({v}, r'{scalar}', 1) WHEN {v} RLIKE r'{whole}' THEN regexp_extract({v}, r'{whole}', 1) "
    if depth:
        x = f"x{depth}"
        values = f"from_json({v}, 'arrayValue struct<values array<string>>').arrayValue.values"
        pairs = f"from_json({v}, 'kvlistValue struct<values array<struct<key string, value string>>>').kvlistValue.values"
        key = f"substr(to_json(array({x}.key)), 2, length(to_json(array({x}.key))) - 2)"
        cases += f"""WHEN startswith({v}, '{{"arrayValue":') THEN concat('[', array_join(transform({values}, {x} -> {unwrap(x, depth - 1)}), ','), ']') """
        cases += f"""WHEN startswith({v}, '{{"kvlistValue":') THEN concat('{{', array_join(transform({pairs}, {x} -> concat({key}, ':', {unwrap(f"{x}.value", depth - 1)})), ','), '}}') """
    return f"""CASE WHEN NOT startswith({v}, '{{"') THEN {v} {cases} ELSE {v} END"""


def unwrapped(values: str) -> str:
    """SQL for a map with every value unwrapped."""
    return f"transform_values({values}, (k, v) -> {unwrap('v')})"


def listed(items: str) -> str:
    """SQL for a list of (key, value) as a map of unwrapped JSON texts; of equal keys the last holds."""
    step = "(m, x) -> CASE WHEN x.key IS NULL THEN m ELSE map_concat(map_filter(m, (k, v) -> k != x.key), map(x.key, x.value)) END"
    return unwrapped(f"aggregate({items}, cast(map() AS map<string,string>), {step})")


PAIRS = "array<struct<key string, value string>>"
NOTHING = "cast(map() AS map<string,string>)"
JSON_MAP = "transform_values(cast(CASE WHEN startswith({0}, '{{') THEN try_parse_json({0}) END AS map<string,variant>), (k, v) -> coalesce(to_json(v), 'null'))"


def attribute_list(text: str) -> str:
    """SQL for a list of {key, value}, or an object, as a map of unwrapped JSON texts; empty for anything else."""
    items = f"from_json(CASE WHEN startswith({text}, '[') THEN {text} END, '{PAIRS}')"
    return f"coalesce({listed(items)}, {unwrapped(JSON_MAP.format(text))}, {NOTHING})"


def _records() -> Column:
    """The log records of an OTLP envelope with the attributes of their resource and scope."""
    scope = f"struct<scope struct<name string, attributes {PAIRS}>, logRecords array<string>, log_records array<string>>"
    resource = f"array<struct<resource struct<attributes {PAIRS}>, scopeLogs array<{scope}>, scope_logs array<{scope}>>>"
    parsed = f"from_json(doc_text, 'resourceLogs {resource}, resource_logs {resource}')"
    named = f"coalesce({listed('s.scope.attributes')}, {NOTHING})"
    with_name = f"CASE WHEN s.scope.name != '' THEN map_concat(map_filter({named}, (k, v) -> k != 'scope.name'), map('scope.name', substr(to_json(array(s.scope.name)), 2, length(to_json(array(s.scope.name))) - 2))) ELSE {named} END"
    record = f"struct(r AS doc, coalesce({listed('l.resource.attributes')}, {NOTHING}) AS resource, {with_name} AS scope)"
    records = f"transform(coalesce(s.logRecords, s.log_records), r -> {record})"
    scopes = f"flatten(filter(transform(coalesce(l.scopeLogs, l.scope_logs), s -> {records}), x -> x IS NOT NULL))"
    return F.expr(f"flatten(filter(transform(coalesce({parsed}.resourceLogs, {parsed}.resource_logs), l -> {scopes}), x -> x IS NOT NULL))").cast(RECORD)


def classified(events: DataFrame, formats: set[str]) -> DataFrame:
    """Adds kind, g (groups of the line), the text and fallback stamp of plain reading, and the document, one row per record."""
    fmt = F.col("format")
    shape = F.lit(None).cast("array<string>")
    for name, (pattern, n) in (SHAPES | {f.name: (f.line, f.groups) for f in ADDED.values()}).items():
        if name in formats:
            shape = F.when(fmt == name, groups(F.col("line"), pattern, n)).otherwise(shape)
    e = events.withColumn("g", shape)
    nothing = F.lit(None).cast("string")
    if "cri" in formats:
        e = e.withColumn("cri", F.when(fmt == "cri", groups(F.col("line"), fold.CRI_LINE, 4)))
        payload = F.concat(F.col("cri")[3], F.array_join(F.transform("extra", lambda x: F.regexp_extract(x, fold.CRI_LINE, 4)), ""))
        e = e.withColumn("payload", F.when(F.col("cri").isNotNull(), payload)).withColumn("extra", F.when(fmt == "cri", F.array().cast("array<string>")).otherwise(F.col("extra")))
    else:
        e = e.withColumn("cri", F.lit(None).cast("array<string>")).withColumn("payload", nothing)
    if not formats & {"json", "cri"}:
        kind = F.when((fmt == "logfmt") | F.col("g").isNotNull(), fmt).otherwise("plain")
        return e.withColumns({"kind": kind, "text": F.col("line"), "fallback": stamps.none(), "stream": nothing, "seq": F.lit(0)})
    e = e.withColumn("doc_text", F.when(fmt == "json", strip(F.col("line"))).when(F.col("payload").isNotNull(), strip(F.col("payload"))))
    objects = lambda tree: texts_of(F.col(tree).cast("map<string,variant>"))
    e = e.withColumn("tree", tree_of(F.col("doc_text"))).withColumn("doc", objects("tree"))  # a text is parsed once
    has = lambda k: F.coalesce(F.map_contains_key("doc", k), F.lit(False))
    docker = (fmt == "json") & F.coalesce(F.col("flavor") == "docker", F.lit(False)) & has("log") & has("stream")
    kind = (
        F.when(docker, "docker")
        .when(has("resourceLogs") | has("resource_logs"), "envelope")
        .when(F.col("doc").isNotNull(), "json")
        .when((fmt == "logfmt") | F.col("g").isNotNull(), fmt)
        .otherwise("plain")
    )
    e = e.withColumn("kind", kind)
    one = F.expr(f"array(struct(cast(null AS string) AS doc, {NOTHING} AS resource, {NOTHING} AS scope))").cast(RECORD)
    records = F.when(F.col("kind") == "envelope", F.slice(_records(), 1, F.when(fmt == "cri", 1).otherwise(1 << 30))).otherwise(one)
    inner = F.col("kind") == "envelope"
    e = e.withColumn("records", records)
    # The text of an envelope is not copied to each of its records; that of a CRI line has one.
    shed = {c: F.when(~inner | (fmt == "cri"), F.col(c)) for c in ("line", "raw")} | {c: F.when(~inner, F.col(c)) for c in ("doc_text", "tree", "doc")}
    e = e.withColumns(shed).select("*", F.posexplode_outer("records").alias("seq", "record")).drop("records").filter("seq is not null")  # a plain one would work out all records for a filter first
    e = e.withColumn("doc_text", F.when(inner, F.col("record.doc")).otherwise(F.col("doc_text")))
    e = e.withColumn("tree", F.when(inner, tree_of(F.col("record.doc"))).otherwise(F.col("tree"))).withColumn("doc", F.when(inner, objects("tree")).otherwise(F.col("doc")))
    log = F.rtrim(json_plain(F.element_at("doc", "log")), F.lit("\n"))
    e = e.withColumn("text", F.when(F.col("kind") == "docker", log).when(F.col("payload").isNotNull(), F.rtrim("payload", F.lit("\n"))).otherwise(F.col("line")))
    outer = F.element_at("doc", "time")
    fallback = F.when(F.col("kind") == "docker", stamps.of_json(outer, json_plain(outer))).when(F.col("cri").isNotNull(), stamps.iso(F.col("cri")[0]))
    stream = F.when(F.col("kind") == "docker", F.element_at("doc", "stream")).when(F.col("cri").isNotNull(), json_string(F.col("cri")[1]))
    return e.withColumn("fallback", fallback).withColumn("stream", stream)


def read_plain(e: DataFrame, year: Column) -> DataFrame:
    """Adds lead, word and logger pieces for rows that are read as plain text."""
    plain = F.col("kind").isin("plain", "docker")
    e = e.withColumn("lead", F.when(plain, stamps.leading(F.col("text"), year)))
    rest = F.col("lead.rest")
    head = F.left(rest, F.lit(80))
    e = e.withColumn("word", F.when(plain, levels.first_word(head)))
    at = F.regexp_instr(head, F.lit(levels.WORD_PATTERN))
    cut = strip(F.concat(F.left(rest, at - 1), F.substr(rest, at + F.length("word"))), " \t-|:")
    e = e.withColumn("rest", F.when(F.col("word") != "", cut).otherwise(rest))
    near = F.left("rest", F.lit(120))
    e = e.withColumn("found", F.when(plain, F.regexp_extract(near, LOGGER, 0)))
    name = F.substr("found", F.lit(2), F.length("found") - 2)
    valid = (F.col("found") != "") & ~F.rlike(name, F.lit(r"(?U)^\d+$")) & ~F.upper(name).isin(*NOT_LOGGER.split())
    e = e.withColumn("logger", F.when(valid, name))
    start = F.expr("locate(found, rest)")
    without = strip(F.concat(F.left("rest", start - 1), F.substr("rest", start + F.length("found"))), " \t-|:")
    return e.withColumn("said", F.when(F.col("logger").isNotNull(), F.coalesce(filled(without), F.col("rest"))).otherwise(F.col("rest")))


#: The fields of an entry, each a column of its own, so a plan works out only those that are asked for.
Entry = dict[str, Column]


def entry(**fields: Column) -> Entry:
    empty = {"stamp": stamps.none(), "attributes": empty_map(), "correlation_keys": empty_map()}
    nothing = F.lit(None).cast("string")
    return {f: fields.get(f, empty.get(f, nothing)) for f in FIELDS}


def declared_logger(name: Column) -> Column:
    return F.when(F.col("service_declared"), json_string(name))


def plain_entry() -> Entry:
    level = F.coalesce(levels.of_word(F.col("word")), F.lit("info"))
    stderr = (F.col("cri")[1] == "stderr") & (level == "info")
    return entry(
        stamp=F.coalesce(F.col("lead.found"), F.col("fallback")),
        level=F.when(F.coalesce(stderr, F.lit(False)), "warn").otherwise(level),
        message=with_extra(strip(F.col("said"))),
        service=F.col("logger"),
        attributes=map_of(("logger", declared_logger(F.col("logger"))), ("stream", F.col("stream"))),
    )


def clf_entry() -> Entry:
    g = F.col("g")
    request, status, tail = F.split(g[3], " ", -1), g[4].cast("int"), g[8]
    path = F.coalesce(F.get(request, F.lit(1)), F.lit(""))
    took = F.regexp_extract(tail, DURATION, 1).try_cast("double")
    attributes = map_of(
        ("http.method", json_string(request[0])), ("http.path", json_string(path)), ("http.status", g[4].cast("int")), ("client.ip", json_string(g[0])),
        ("http.protocol", json_string(filled(F.get(request, F.lit(2))))), ("http.response_bytes", g[5].try_cast("bigint")),
        ("http.referer", json_string(filled(g[6]))), ("http.user_agent", json_string(filled(g[7]))), ("http.user", json_string(F.nullif(g[1], F.lit("-")))),
        ("duration_ms", F.when(took < 1000, took * 1000).otherwise(took)),
    )
    request_id = F.coalesce(filled(F.regexp_extract(tail, REQUEST_ID, 1)), filled(F.regexp_extract(tail, BARE_ID, 1)))
    return entry(
        stamp=stamps.clf(g[2]),
        level=F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info"),
        message=strip(F.concat(request[0], F.lit(" "), path, F.lit(" → "), g[4])),
        attributes=attributes,
        correlation_keys=map_of(("request_id", request_id)),
    )


def postgres_entry() -> Entry:
    g = F.col("g")
    message = with_extra(F.rtrim(g[6], F.lit(" \t\n\r")))
    who = r"(?U)\b([\w.-]+)@([\w.-]+)\b"
    prefix = strip(g[4])
    attributes = map_of(
        ("pg_pid", g[2]), ("pg_session_line", filled(g[3])), ("db.user", json_string(filled(F.regexp_extract(prefix, who, 1)))), ("db.name", json_string(filled(F.regexp_extract(prefix, who, 2)))),
        ("duration_ms", F.regexp_extract(message, r"\bduration:\s*([\d.]+)\s*ms", 1).try_cast("double")),
    )
    return entry(
        stamp=stamps.iso(F.when(F.rlike(g[1], F.lit(r"^[+-]\d{2}$")), F.concat(g[0], g[1], F.lit("00"))).when(F.rlike(g[1], F.lit("^[+-]")), F.concat(g[0], g[1])).otherwise(g[0])),
        level=levels.named(g[5]),
        message=message,
        attributes=attributes,
        correlation_keys=map_of(("pg_pid", g[2])),
    )


def syslog5424_entry() -> Entry:
    g = F.col("g")
    rest = g[6]
    opening = F.regexp_extract(rest, rf"(?s)^(?:{SD_ELEMENT})+", 0)
    elements = F.arrays_zip(F.regexp_extract_all(opening, F.lit(SD_ELEMENT), F.lit(1)).alias("id"), F.regexp_extract_all(opening, F.lit(SD_ELEMENT), F.lit(2)).alias("body"))

    def params(x: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(x["body"], F.lit(SD_PARAM), F.lit(1)).alias("k"), F.regexp_extract_all(x["body"], F.lit(SD_PARAM), F.lit(2)).alias("v"))
        return F.transform(pairs, lambda p: F.struct(F.concat(x["id"], F.lit("."), p["k"]).alias("key"), F.replace(p["v"], F.lit('\\"'), F.lit('"')).alias("value")))

    found = last_wins(F.flatten(F.transform(elements, params)))
    nil = rest.startswith("-")
    message = F.when(nil, F.ltrim(F.substr(rest, F.lit(2)))).otherwise(F.ltrim(F.substr(rest, F.length(opening) + 1)))
    app = F.nullif(g[3], F.lit("-"))
    own = map_of(("host", json_string(F.nullif(g[2], F.lit("-")))), ("msgid", json_string(F.nullif(g[5], F.lit("-")))), ("logger", declared_logger(app)))
    keys = F.map_filter(F.transform_keys(found, lambda k, _: k), lambda k, _: F.lower(F.element_at(F.split(k, r"\."), -1)).isin(*SD_KEYS.split()))
    short = last_wins(F.transform(F.map_entries(keys), lambda x: F.struct(F.lower(F.element_at(F.split(x.key, r"\."), -1)).alias("key"), x.value.alias("value"))))
    return entry(
        stamp=stamps.iso(g[1]),
        level=levels.of_priority(g[0]),
        message=with_extra(message),
        service=app,
        attributes=over(F.transform_values(found, lambda _, v: json_string(v)), own),
        correlation_keys=over(map_of(("pid", F.nullif(g[4], F.lit("-")))), short),
    )


def syslog_entry(year: Column) -> Entry:
    g = F.col("g")
    word = levels.of_word(levels.first_word(F.left(g[5], F.lit(80))))
    return entry(
        stamp=stamps.syslog(g[1], year),
        level=F.when(g[0] != "", levels.of_priority(filled(g[0]))).otherwise(F.coalesce(word, F.lit("info"))),
        message=with_extra(g[5]),
        service=g[3],
        attributes=map_of(("host", json_string(g[2])), ("logger", declared_logger(g[3]))),
        correlation_keys=map_of(("pid", filled(g[4]))),
    )


def read_logfmt(e: DataFrame, year: Column) -> DataFrame:
    """Adds pairs (lower-case keys, last wins), the key that serves each field, and the text outside the pairs."""
    is_logfmt = F.col("kind") == "logfmt"
    inner = lambda v: F.substr(v, F.lit(2), F.length(v) - 2)
    quoted = lambda v: (F.length(v) >= 2) & (F.left(v, F.lit(1)) == F.right(v, F.lit(1))) & F.left(v, F.lit(1)).isin('"', "'")

    def unquoted(v: Column) -> Column:
        x = inner(v)
        for a, b in (('\\"', '"'), ("\\'", "'"), ("\\n", "\n"), ("\\\\", "\\")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return F.when(quoted(v), x).otherwise(v)

    found = F.arrays_zip(F.regexp_extract_all("line", F.lit(fold.LOGFMT_PAIR), F.lit(1)).alias("k"), F.regexp_extract_all("line", F.lit(fold.LOGFMT_PAIR), F.lit(2)).alias("v"))
    pairs = last_wins(F.transform(found, lambda x: F.struct(F.lower(x["k"]).alias("key"), unquoted(x["v"]).alias("value"))))
    outside = F.filter(F.transform(F.split("line", fold.LOGFMT_PAIR, -1), lambda x: strip(x)), lambda x: x != "")
    e = e.withColumn("pairs", F.when(is_logfmt, pairs)).withColumn("leftover", F.when(is_logfmt, F.array_join(outside, " ")))
    taken = F.struct(*[F.get(F.filter(F.array(*[F.lit(k) for k in keys.split()]), lambda k: F.map_contains_key("pairs", k)), F.lit(0)).alias(f) for f, keys in LOGFMT.items()])
    e = e.withColumn("taken", F.when(is_logfmt, taken))
    raw = F.element_at("pairs", F.col("taken.time"))
    own = F.coalesce(stamps.iso(raw), F.when(F.rlike(raw, F.lit(r"^\d+$")), stamps.epoch(raw)))
    e = e.withColumn("own_stamp", F.when(is_logfmt, own))
    return e.withColumn("ahead", F.when(is_logfmt & F.col("own_stamp").isNull(), stamps.leading(F.col("leftover"), year)))


def logfmt_entry() -> Entry:
    pairs = F.col("pairs")
    value = lambda f: F.element_at(pairs, F.col(f"taken.{f}"))
    used = F.array(*[F.coalesce(F.col(f"taken.{f}"), F.lit("")) for f in LOGFMT])
    rest = F.map_filter(pairs, lambda k, _: ~F.array_contains(used, k))
    attributes = F.transform_values(rest, lambda _, v: F.when(v == "", F.lit('""')).otherwise(scalar_json(v)))
    logger = F.when(~F.map_contains_key(rest, "logger"), declared_logger(filled(value("service"))))
    leftover = F.coalesce(F.col("ahead.rest"), F.col("leftover"))
    return entry(
        stamp=F.coalesce(F.col("own_stamp"), F.col("ahead.found")),
        level=levels.named(value("level")),
        message=with_extra(F.coalesce(filled(value("message")), leftover)),
        service=filled(value("service")),
        trace_id=filled(value("trace")),
        span_id=filled(value("span")),
        attributes=over(map_of(("logger", logger)), attributes),
        correlation_keys=F.map_filter(rest, lambda k, _: k.isin(*LOGFMT_KEYS.split())),
    )


def read_json(e: DataFrame) -> DataFrame:
    """Adds full (keys and dotted paths to JSON texts) and hit: for each field the first candidate with a value.

    Paths are looked up only where a document holds an object.
    """
    is_json = F.col("kind").isin("json", "envelope")
    nested = map_of(*[(k, F.to_json(F.try_variant_get(F.col("tree"), "$." + k, "variant"))) for k in DOTTED])
    deep = F.exists(F.map_values("doc"), lambda v: F.startswith(v, F.lit("{")))
    e = e.withColumn("full", F.when(is_json, F.when(deep, over(nested, F.col("doc"))).otherwise(F.col("doc"))))
    idle = lambda v: v.isin("null", '""')
    e = e.withColumn("valued", F.when(F.exists(F.map_values("full"), idle), F.map_filter("full", lambda _, v: ~idle(v))).otherwise(F.col("full")))
    flavor = F.when(F.col("kind") == "envelope", "otlp").when(F.col("format") == "json", F.col("flavor"))
    e = e.withColumn("dialect", flavor)

    def first(field: str) -> Column:
        names = F.array(*[F.lit(k) for k in GENERIC[field].split()])
        keys = names
        for name, fields in FLAVORS.items():
            if field in fields:
                keys = F.when(F.col("dialect") == name, F.concat(F.array(*[F.lit(k) for k in fields[field].split()]), names)).otherwise(keys)
        return _first(keys)

    hits = [first(f).alias(f) for f in GENERIC]
    numbers = _first(F.array(*[F.lit(k) for k in SEVERITY_NUMBERS.split()])).alias("number")
    return e.withColumn("hit", F.when(is_json, F.struct(*hits, numbers)))


def _first(keys: Column) -> Column:
    key = F.get(F.array_intersect(keys, F.map_keys("valued")), F.lit(0))
    return F.struct(key.alias("key"), F.element_at("valued", key).alias("value"))


def plain_of(value: str) -> str:
    """SQL for the text of a JSON value: strings without quotes; null for JSON null."""
    bare = f"substr({value}, 2, length({value}) - 2)"
    return f"""CASE WHEN startswith({value}, '"') AND NOT contains({value}, r'\\') THEN {bare} WHEN startswith({value}, '"') THEN get_json_object(concat('{{"x":', {value}, '}}'), '$.x') WHEN {value} != 'null' THEN {value} END"""


def identity(value: str) -> Column:
    """A trace or span identifier; empty and all-zero ones are none, the path before one is dropped."""
    text = strip(F.expr(plain_of(value)))
    kept = F.when(~text.isin("", "0", "0" * 16, "0" * 32), text)
    return filled(F.when(kept.startswith("projects/"), F.element_at(F.split(kept, "/"), -1)).otherwise(kept))


def json_pieces(e: DataFrame) -> DataFrame:
    """Adds the texts of the fields that hit, the keys they use up, and the attributes from each place."""
    said = ("level", "message", "service")
    e = e.withColumns({f"bare_{f}": F.expr(unwrap(f"hit.{f}.value")) for f in said})
    e = e.withColumns({f"said_{f}": F.when(F.col("full").isNotNull(), F.coalesce(F.expr(plain_of(f"bare_{f}")), F.lit(""))) for f in said})
    number = F.when(F.col("hit.level.value").isNull(), F.col("hit.number.key"))
    used = F.array(*[F.coalesce(F.col(f"hit.{f}.key"), F.lit("")) for f in ("timestamp", "level", "message", "service")], F.coalesce(number, F.lit("")))
    e = e.withColumn("used", F.when(F.col("full").isNotNull(), used))
    free = "CASE WHEN NOT array_contains(used, '{0}') THEN doc['{0}'] END"
    lists = {f"list_{i}": F.expr(f"CASE WHEN map_contains_key(doc, '{k}') AND full IS NOT NULL THEN {free.format(k)} END") for i, k in enumerate(("attributes", "Attributes", "resource", "Resource"))}
    e = e.withColumns(lists)
    e = e.withColumns({k: F.expr(f"CASE WHEN {k} IS NOT NULL THEN {attribute_list(k)} ELSE {NOTHING} END") for k in lists})
    taken_apart = "k IN ('attributes', 'Attributes', 'resource', 'Resource') AND (startswith(v, '[') OR startswith(v, '{'))"
    own = f"CASE WHEN full IS NOT NULL THEN map_filter(doc, (k, v) -> NOT array_contains(used, k) AND k != 'v' AND NOT ({taken_apart})) END"
    typed = """exists(map_values(own), v -> startswith(v, '{"'))"""
    return e.withColumn("own", F.expr(own)).withColumn("own", F.expr(f"CASE WHEN {typed} THEN {unwrapped('own')} ELSE own END"))


def json_entry() -> Entry:
    numeric = F.rlike("hit.level.value", F.lit(r"^-?\d"))
    banded = F.coalesce(F.col("dialect") == "otlp", F.lit(False))
    level = (
        F.when(numeric, levels.of_number(F.col("hit.level.value"), banded))
        .when(F.col("hit.level.value").isNotNull(), levels.named(F.col("said_level")))
        .when(F.col("hit.number.value").isNotNull(), levels.of_number(F.expr(plain_of("hit.number.value")), F.lit(True)))
        .otherwise("info")
    )
    extra = over(_prefixed("resource.", F.col("record.resource")), _prefixed("scope.", F.col("record.scope")))
    listed_pairs = over(F.col("list_0"), F.col("list_1"))
    resources = over(_prefixed("resource.", F.col("list_2")), _prefixed("resource.", F.col("list_3")))
    logger = F.when(F.col("service_declared") & (F.col("said_service") != ""), json_string(F.col("said_service")))
    first = map_of(("logger", logger), ("stream", F.col("stream")))
    own = F.col("own")
    more = F.size("record.resource") + F.size("record.scope") + sum(F.size(f"list_{i}") for i in range(4)) > 0
    attributes = F.when(more, over(first, over(over(over(extra, listed_pairs), resources), own))).when(logger.isNotNull() | F.col("stream").isNotNull(), over(first, own)).otherwise(own)
    wanted = "array(" + ", ".join(f"'{k}'" for k in JSON_KEYS.split()) + ")"
    value = "coalesce(nullif(doc[k], 'null'), own[k], list_0[k], list_1[k])"
    there = f"array_intersect({wanted}, concat(map_keys(doc), map_keys(list_0), map_keys(list_1)))"
    found = f"transform({there}, k -> struct(k AS key, {value} AS value))"
    pairs = F.expr(f"map_from_entries(filter(transform({found}, p -> struct(p.key AS key, {plain_of('p.value')} AS value)), p -> p.value != ''))")
    when = F.col("hit.timestamp.value")
    return entry(
        stamp=F.coalesce(stamps.of_json(when, F.expr(plain_of("hit.timestamp.value"))), F.col("fallback")),
        level=level,
        message=F.coalesce(filled(F.col("said_message")), F.left(F.to_json("tree"), F.lit(2000))),
        service=F.coalesce(filled(F.col("said_service")), F.expr(f"nullif({plain_of('record.resource[' + chr(39) + 'service.name' + chr(39) + ']')}, '')")),
        trace_id=identity("hit.trace_id.value"),
        span_id=identity("hit.span_id.value"),
        parent_span_id=identity("hit.parent_span_id.value"),
        attributes=attributes,
        correlation_keys=pairs,
    )


def _prefixed(prefix: str, values: Column) -> Column:
    return F.transform_keys(values, lambda k, _: F.concat(F.lit(prefix), k))


def parse(sources: DataFrame, year: int | None, formats: Iterable[str] = FORMATS) -> DataFrame:
    """Entries of described sources before time resolution; see parse_events."""
    return parse_events(fold.fold(sources, set(formats)), year, formats)


def parse_events(events: DataFrame, year: int | None, formats: Iterable[str] = FORMATS) -> DataFrame:
    """(file columns, line_no, seq, stamp, level, message, ids, maps, raw) of folded events.

    ``formats`` names those that occur in ``sources``; the plan holds no branch for others.
    """
    y, formats = F.lit(year or 0), set(formats)
    kind = F.col("kind")
    e = read_plain(classified(events, formats), y)
    branches: dict[str, Entry] = {}
    if formats & {"json", "cri"}:
        e = json_pieces(read_json(e))
        branches |= dict.fromkeys(("json", "envelope"), json_entry())
    if "logfmt" in formats:
        e = read_logfmt(e, y)
        branches["logfmt"] = logfmt_entry()
    for name, make in {"clf": clf_entry, "postgres": postgres_entry, "syslog5424": syslog5424_entry, "syslog": lambda: syslog_entry(y)}.items():
        if name in formats:
            branches[name] = make()
    branches |= {f.name: f.entry(F.col("g")) for f in ADDED.values() if f.name in formats}
    made = plain_entry()
    for name, branch in branches.items():
        made = {f: F.when(kind == name, branch[f]).otherwise(made[f]) for f in FIELDS}
    e = e.withColumns({f"made_{f}": c for f, c in made.items()})
    service = F.when(F.col("service_declared"), F.col("service")).otherwise(F.coalesce(filled(F.col("made_service")), F.col("service")))
    raw = F.col("raw")
    if "json" in formats:
        raw = F.when((kind == "envelope") & (F.col("format") == "json"), F.left("doc_text", F.lit(4000))).otherwise(raw)
    return e.select(
        "file_id", "file_idx", "line_no", "seq", service.alias("service"), "role", F.col("made_stamp.ts").alias("ts"), F.col("made_stamp.offset_s").alias("offset_s"),
        *[F.col(f"made_{f}").alias(f) for f in ("level", "message", "trace_id", "span_id", "parent_span_id", "attributes", "correlation_keys")], raw.alias("raw"),
    )
