"""JSON lines are parsed once, and an envelope's text is not copied to its records."""

import re

from pyspark.sql import functions as F

from tidemark.operators import parse, redact
from tidemark.schema import DETECT_LINES
from tidemark.sources.files import lines_of


def folded(spark, line: str):
    fixed = {"file_id": "f0", "service": "app", "role": "backend", "format": "json", "flavor": None, "line": line, "raw": line}
    return spark.range(1).select(F.lit(0).alias("file_idx"), F.lit(1).alias("line_no"), F.lit(False).alias("service_declared"), F.array().cast("array<string>").alias("extra"), *[F.lit(v).cast("string").alias(c) for c, v in fixed.items()])


def test_no_filter_parses_the_lines(spark):
    events = folded(spark, "{}").withColumn("line", F.concat(F.lit('{"n":'), F.rand().cast("string"), F.lit("}")))
    plan = parse.parse_events(events, 2024, {"json"})._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Filter [^\n]*(?:parse_?json|from_json|map_contains_key)", plan, re.I)


def test_records_do_not_carry_their_envelope(spark):
    record = '{"body":{"stringValue":"m"}}'
    line = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[' + ",".join([record] * 3) + "]}]}]}"
    rows = parse.classified(folded(spark, line), {"json"}).select("kind", "line", "raw", "doc_text", "seq").collect()
    assert [tuple(r) for r in rows] == [("envelope", None, None, record, i) for i in range(3)]
    assert [r.raw for r in parse.parse_events(folded(spark, line), 2024, {"json"}).collect()] == [record] * 3


def test_only_the_first_lines_are_taken_apart(spark):
    source = spark.createDataFrame([(0, "\n \n".join(f"l{i}" for i in range(300)))], "file_idx int, content string")
    assert [r.line for r in lines_of(source, "file_idx", first=DETECT_LINES).orderBy("line_no").collect()] == [f"l{i}" for i in range(DETECT_LINES)]


def test_keys_that_end_like_secrets_are_not_looked_at_twice(spark):
    texts = {"user_id=7 kind: x": False, "PassWord = x": True, "api-key:x": True, "refresh_token=x": True, "Authorization: x": True, "pwd=x": True, "passwd=x": True, "client_secret=x": True}
    only = redact.Policy(disabled=frozenset(set(redact.RULES) - {"secret_kv"}))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.rlike("t", F.lit(only.prefilter())).alias("near"), F.size(redact.redacted(F.col("t"), only)["rules"]).alias("n"))
    assert {r.t: (r.near, r.n) for r in rows.collect()} == {t: (hit, int(hit)) for t, hit in texts.items()}
