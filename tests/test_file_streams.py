"""Streams of growing files, cut at any line and restarted from their checkpoint, give what the whole files give."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_scan import lines_of
from tidemark.operators import fold, normalize, parse
from tidemark.schema import MAX_CONTINUATIONS
from tidemark.streaming import files

@pytest.fixture(autouse=True)
def store(spark):
    before = {k: spark.conf.get(k, None) for k in files.STORE}
    with files.state_store(spark):
        yield
    assert before == {k: spark.conf.get(k, None) for k in files.STORE}


LINE = "file_id string, file_idx long, service string, service_declared boolean, role string, format string, flavor string, line_no long, line string"


def run(spark, tmp_path, chunks, plan):
    """Rows of ``plan`` over a stream of ``chunks``, each read by a new query from the checkpoint of the one before."""
    arriving, out, marks = (str(tmp_path / n) for n in ("arriving", "out", "marks"))
    spark.createDataFrame([], LINE).write.parquet(arriving)
    for chunk in chunks:
        spark.createDataFrame(chunk, LINE).repartition(2).write.mode("append").parquet(arriving)
        stream = plan(spark.readStream.schema(LINE).parquet(arriving))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return spark.read.parquet(out)


def chunks_of(rows, seed: int, n: int):
    """Lines file by file in order, cut at places that differ by file; some come twice; ends of files come last."""
    rng, chunks = random.Random(seed), [[] for _ in range(n)]
    by_file: dict = {}
    for r in rows:
        by_file.setdefault(r[0], []).append(r)
    for part in by_file.values():
        part.sort(key=lambda r: r[7])
        cuts = sorted(rng.randrange(len(part) + 1) for _ in range(n - 1))
        for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(part)])):
            chunks[i] += part[max(0, a - rng.randrange(3)) : b]
        chunks[-1].append((*part[0][:7], part[-1][7] + 1, None))
    return [rng.sample(c, len(c)) for c in chunks]


def test_a_stream_folds_like_whole_files(spark, tmp_path):
    lines = lines_of(spark, 5)
    rows = [tuple(r) for r in lines.collect()]
    blank = (*rows[0][:7], 100_000, "  \t")
    formats = {r[5] for r in rows}
    got = run(spark, tmp_path, chunks_of([*rows, blank], 5, 4), lambda s: files.fold_stream(s, formats, None))
    columns = [*fold.CONTEXT, "line_no", "line", "extra", "raw"]
    key = lambda r: (r.file_id, r.line_no)
    want = fold.fold_lines(lines, formats).select(columns)
    found = sorted((tuple(r) for r in got.select(columns).collect()), key=lambda r: (r[0], r[7]))
    assert found == [tuple(r) for r in sorted(want.collect(), key=key)]
    assert any(len(r[9]) == MAX_CONTINUATIONS + 1 for r in found)


def test_entries_of_a_stream_are_dated_like_those_of_files(spark, tmp_path):
    rows = []
    for f, fmt in enumerate(["plain", "json", "postgres", "cri", "logfmt", "syslog"]):
        for i in range(30):
            at = dt.datetime(2024, 3, 1, 12, f, i)
            clear, dated = i % 4 != 3, at.isoformat() + "Z"
            line = {
                "plain": f"{dated} ERROR event {i}" if clear else f"event {i}",
                "json": f'{{"time":"{dated}","msg":"event {i}","n":{{"k":[{i}]}}}}' if clear else f'{{"msg":"event {i}"}}',
                "postgres": f"{at} UTC [7] LOG:  event {i}" if i % 2 == 0 else f"{at} UTC [7] DETAIL:  more {i}",
                "cri": f"{dated} stdout {'P' if i % 3 else 'F'} event {i}",
                "logfmt": f'ts={dated} level=warn msg="event {i}" a={i}' if clear else f'level=warn msg="event {i}" a={i}',
                "syslog": f"Mar  1 12:00:{i:02} h app[7]: event {i}",
            }[fmt]
            rows.append((f"f{f}", f, f"s{f}", f % 2 == 0, "backend", fmt, None, i + 1, line))
    rows += [("empty", 9, "s", False, "db", "plain", None, i, t) for i, t in ((1, "no stamp"), (2, "none here"))]
    formats = {r[5] for r in rows}
    got = run(spark, tmp_path, chunks_of(rows, 2, 3), lambda s: files.entries_stream(s, 2024, formats, None, "Europe/Berlin", 60))
    zones = {"timezone": F.lit("Europe/Berlin"), "offset_seconds": F.lit(60)}
    want = normalize.resolve(parse.parse_events(fold.fold_lines(spark.createDataFrame(rows, LINE), formats), 2024, formats).withColumns(zones))
    assert sorted(got.columns) == sorted(want.columns)
    told = lambda df: sorted(map(str, (r.asDict() for r in df.select(sorted(want.columns)).collect())))
    assert told(got) == told(want)
    kinds = {(r.file_id, r.time_source) for r in got.collect()}
    assert {("f0", "carried"), ("f1", "carried"), ("f2", "zone"), ("f3", "offset"), ("f5", "zone"), ("empty", "none")} <= kinds


def test_an_open_event_goes_out_after_its_timeout(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("ERROR first\n")
    fixed = "'f' file_id", "0L file_idx", "'s' service", "false service_declared", "'db' role", "'plain' format", "cast(null as string) flavor", "1L line_no", "value line"
    lines = spark.readStream.text(str(tmp_path / "in")).selectExpr(*fixed)
    query = files.fold_stream(lines, {"plain"}, 100).writeStream.format("memory").queryName("timed_out").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table("timed_out").count():
                break
            query.awaitTermination(1)
        assert [r.raw for r in spark.table("timed_out").collect()] == ["ERROR first"]
    finally:
        query.stop()


def appended(spark, tmp_path, chunks, formats, shifts):
    """Entries of ``chunks``, each read by a new query that goes on from the folder of the one before."""
    arriving, folder = str(tmp_path / "arriving"), str(tmp_path / "folder")
    spark.createDataFrame([], LINE).write.parquet(arriving)
    for chunk in chunks:
        spark.createDataFrame(chunk, LINE).repartition(2).write.mode("append").parquet(arriving)
        lines = spark.readStream.schema(LINE).parquet(arriving)
        query = files.append_entries(lines, folder, 2024, formats, "Europe/Berlin", 60, shifts).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    return files.appended(spark, folder)


def test_appended_entries_are_those_of_whole_files(spark, tmp_path):
    rows = [tuple(r) for r in lines_of(spark, 5).filter("format in ('plain', 'json', 'cri')").collect()]
    for f, fmt in enumerate(["plain", "json", "cri"]):
        for i in range(30):
            dated = dt.datetime(2024, 3, 1, 12, f, i).isoformat() + "Z"
            line = {"plain": f"{dated} ERROR event {i}" if i % 4 else f"event {i}", "json": f'{{"time":"{dated}","msg":"event {i}"}}' if i % 5 == 2 else f'{{"msg":"event {i}"}}', "cri": f"{dated} stdout {'P' if i % 3 else 'F'} event {i}"}[fmt]
            rows.append((f"g{f}", 200 + f, "s", True, "backend", fmt, None, 7 * i + 1, line))
    formats = {r[5] for r in rows}
    chunks = chunks_of(rows, 5, 2)
    chunks[1] += chunks[1][:20]  # lines that are there twice in a trigger
    ended = max(r[7] for r in rows if r[0] == "g0")
    chunks.append([("g0", 200, "s", True, "backend", "plain", None, ended + i, t) for i, t in ((2, "  after the end"), (3, "  more"), (4, None))])
    got = appended(spark, tmp_path, chunks, formats, (3, 6, 63))
    zones = {"timezone": F.lit("Europe/Berlin"), "offset_seconds": F.lit(60)}
    made = lambda lines: normalize.own_stamps(parse.parse_events(fold.fold_lines(spark.createDataFrame(lines, LINE), formats), 2024, formats).withColumns(zones))
    columns = ["file_id", "line_no", "seq", "raw", "message", "level", "service", "attributes"]
    told = lambda df: sorted(str(r.asDict()) for r in df.select(columns).collect())
    tail = [r for r in chunks[-1] if r[8]]
    assert told(got) == sorted(told(made(rows)) + told(made(tail)))
    own, last = {}, {}
    for r in sorted((r for part in (rows, tail) for r in made(part).select("file_id", "line_no", "seq", "own").collect()), key=lambda r: r[:3]):
        last[r.file_id] = r.own or last.get(r.file_id)
        own[r.file_id, r.line_no, r.seq] = last[r.file_id]
    found = got.select("file_id", "line_no", "seq", "timestamp", "time_source").collect()
    assert all(r.timestamp == own[r.file_id, r.line_no, r.seq] and (r.time_source == "none") == (r.timestamp is None) for r in found)
    assert {r.time_source for r in found} == {"none", "carried", "offset"}


def test_no_python_worker_sees_a_line(spark, tmp_path, monkeypatch):
    """A trigger may bring any number of lines of a file: plans of its tables have no Python."""
    plans, frame = [], type(spark.range(0))
    write = frame.write.fget
    monkeypatch.setattr(frame, "write", property(lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df)))
    rows = [("f", 0, "s", False, "db", "plain", None, i, f"2024-03-01T00:00:0{i}Z ERROR {i}") for i in range(9)]
    assert appended(spark, tmp_path, [rows], {"plain", "cri"}, (1, 2, 63)).count() == 8
    assert len(plans) > 5 and not any("Python" in p or "Pandas" in p or "TransformWithState" in p for p in plans)
