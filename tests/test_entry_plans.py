"""A plan works out what is asked for: fields of entries, formats that are not declared, one pass for a report."""

from tidemark import queries
from tidemark.operators import detect, parse
from tidemark.sources.files import described, file_set


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_that_are_not_asked_for_are_not_made(spark):
    files = described(file_set(spark, [{"name": "a.log", "content": "level=info msg=m x=1", "format": "logfmt"}])).withColumn("flavor", queries.F.lit(None).cast("string"))
    made = parse.parse(files, 2024, {"logfmt"})
    assert "map_concat" in plan_of(made) and "map_concat" not in plan_of(made.select("message", "level"))


def test_a_declared_format_is_not_looked_for(spark):
    files = queries.sources(spark, "/root/testdata/sf0.001", "logfmt")
    assert "split(" not in plan_of(detect.detect(files))
    assert {(r.format, r.confidence, r.overridden) for r in detect.detect(files).collect()} == {("logfmt", 1.0, True)}


def test_a_report_parses_once(spark):
    assert plan_of(queries.uneven(spark, "/root/testdata/sf0.001").files).count("Generate") == 1
