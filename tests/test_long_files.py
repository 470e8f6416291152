"""Queries whose stamps are carried through whole files go through them in blocks: no string and no task holds a file."""

import datetime as dt
import functools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators import scan
from tidemark.plans.ingest import ingest, ingest_lines

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["level_counts", "prompt_trim"])
def test_no_file_is_a_string_and_borders_of_blocks_do_not_show(spark, monkeypatch, name):
    def none(*_, **__):
        raise AssertionError("a file as one string")

    monkeypatch.setattr(queries, "sources", none)
    monkeypatch.setattr(queries, "ingest_lines", functools.partial(ingest_lines, shifts=(3, 5, 63)))
    with duckdb.connect() as con:
        con.execute(f"create view events as select * from '{FOLDER}/events.parquet'")
        expected = con.execute(queries.ORACLES[name]).fetchall()
    assert sorted(map(tuple, queries.QUERIES[name](spark, FOLDER).collect())) == sorted(expected)


def test_no_task_dates_a_file(spark):
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", plan_of(queries.level_counts(spark, FOLDER)))
    files = [k for k in keys if "file_idx" in k]
    assert files and sum("_block" in k for k in files) >= len(files) - 2  # totals of a file's blocks meet for its earliest stamp


def test_rows_are_not_broadcast_to_meet_their_totals(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").select((F.col("event_id") % 8).alias("file"), "event_id")  # small enough to be broadcast
    plan = plan_of(scan.before(events, ["file"], "event_id", {"n": (F.lit(1), "sum")}))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_lines_of_odd_events(spark, tmp_path):
    ids = [-17, -9, -1, 0, 8, 8, 8, 16, 7, 70_000, 70_000, 2**40, None, 24]
    texts = ["a", "b", "c\nd", "e", "g", "f\r\n \nf2", "f", None, "h", "j", "i", "k", "lost", "  "]
    spark.createDataFrame(list(zip(ids, texts)), "event_id long, event_type string").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    expected = []
    for f in {i - int(i / 8) * 8 for i in ids if i is not None}:
        mine = sorted((i, t) for i, t in zip(ids, texts) if i is not None and t is not None and i - int(i / 8) * 8 == f)
        lines = re.split("\r\n|\n", "\n".join(t for _, t in mine))
        expected += [(f"f{f}", f"app{f}.log", n, x) for n, x in enumerate(lines, 1) if x.strip()]
    assert sorted(map(tuple, queries.long_files(spark, str(tmp_path), "event_type").collect())) == sorted(expected)


@pytest.mark.parametrize("declared", [None, "logfmt"])
def test_lines_give_what_their_files_give(spark, declared):
    at = dt.datetime(2024, 3, 1)
    texts = ["\n\n".join(f"{'' if i % 3 == f else f'ts={(at + dt.timedelta(seconds=i)).isoformat()}Z '}level=warn msg=m{i} a={f}" + ("\n  more" if i % 7 == 3 else "") for i in range(40)) for f in range(3)]
    files = [(f"f{f}", f"app{f}.log", t) for f, t in enumerate(texts)]
    lines = [(fid, name, n, x) for fid, name, t in files for n, x in enumerate(t.split("\n"), 1) if x]
    source = "file_idx int, name string, content string, service string, role string, format string, timezone string, offset_seconds int"
    whole = ingest(spark.createDataFrame([(i, name, t, None, "db", declared, None, 5) for i, (_, name, t) in enumerate(files)], source), year=2024)
    parts = ingest_lines(spark.createDataFrame(lines, "file_id string, name string, line_no long, line string").repartition(3), year=2024, shifts=(2, 4, 63), role="db", format=declared, offset_seconds=5)
    same = [c for c in whole.entries.columns if c != "file_idx"]
    a, b = (sorted((repr(tuple(r)) for r in e.entries.select(same).collect())) for e in (whole, parts))
    assert a == b and len(a) == 120
    of = ["file_id", "name", "service", "role", "format", "confidence", "evidence", "format_overridden", "entry_count", "first_at", "last_at", "unresolved", "skew_warning"]
    a, b = (sorted((repr(tuple(r)) for r in e.files.select(of).collect())) for e in (whole, parts))
    assert a == b
