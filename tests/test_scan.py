"""Folding, dating and comparing files in blocks gives what one pass over a whole file gives."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from tidemark.operators import fold, normalize, scan
from tidemark.schema import MAX_CONTINUATIONS, MAX_LINE_CHARS

BLOCKS = [(1, 2, 63), (3, 5, 63), scan.LINES]
PIECES = {
    "plain": ["2024-03-01T00:00:00Z ERROR a", "    at x.Y(Z.java:1)", "Caused by: b", "plain words", "x" * (MAX_LINE_CHARS + 5)],
    "json": ['{"a":1}', "  {", "not json"],
    "cri": ["2024-03-01T00:00:00Z stdout P part", "2024-03-01T00:00:00Z stdout F end", "2024-03-01T00:00:00Z stderr P part", "  junk"],
    "postgres": ["2024-03-01 00:00:00 UTC [7] LOG:  a", "2024-03-01 00:00:00 UTC [7] DETAIL:  b", "\tmore", "select 1"],
    "logfmt": ["a=1 b=2", "  c=3", "words"],
}


def lines_of(spark, seed: int):
    rng, rows = random.Random(seed), []
    for i, (fmt, pieces) in enumerate(PIECES.items()):
        number = 0
        for n in (0, 1, 60):
            fid = 10 * i + n % 9
            for _ in range(n):
                number += rng.choice([1, 1, 1, 2, 9, 40])  # blank lines are numbered and left out
                rows.append((f"f{fid}", fid, "s", False, "db", fmt, None, number, rng.choice(pieces)))
    start = len(rows)
    rows += [("fx", 99, "s", False, "db", "plain", None, 3 * i + 1, "head" if i == 0 else "  tail") for i in range(MAX_CONTINUATIONS + 60)]
    assert start > 100
    return spark.createDataFrame(rows, "file_id string, file_idx int, service string, service_declared boolean, role string, format string, flavor string, line_no int, line string").repartition(3)


@pytest.mark.parametrize("shifts", BLOCKS)
def test_fold_in_blocks(spark, shifts):
    for formats in (set(PIECES), set(PIECES) - {"cri"}):
        lines = lines_of(spark, len(formats)).filter(F.col("format").isin(*formats))
        whole, parts = (sorted(map(tuple, df.collect()), key=repr) for df in (fold.fold_lines(lines, formats), fold.fold_blocks(lines, formats, shifts)))
        assert whole == parts and len(parts) > 50
        assert any(r[-2] and r[-2][-1] == fold.CAP_MARK for r in parts)


def test_fold_of_nothing(spark):
    assert fold.fold_blocks(lines_of(spark, 1).limit(0)).collect() == []


def entries(spark, seed: int):
    rng, rows = random.Random(seed), []
    for fid in range(6):
        number = 0
        for _ in range(120):
            number += rng.choice([0, 1, 1, 5, 90])  # several events of one line, and blank lines
            missing = fid == 0 or rng.random() < 0.6 or (fid == 1 and number < 900)
            ts = None if missing else dt.datetime(2024, 3, 1) + dt.timedelta(seconds=rng.randrange(10**6))
            rows.append((f"f{fid}", fid, number, len(rows), ts, rng.choice([None, 3600]), None, rng.choice([0, 7])))
    return spark.createDataFrame(rows, "file_id string, file_idx int, line_no int, seq int, ts timestamp_ntz, offset_s int, timezone string, offset_seconds int").repartition(3)


@pytest.mark.parametrize("shifts", BLOCKS)
def test_time_in_blocks(spark, shifts):
    made = entries(spark, 4)
    whole, parts = (sorted(map(tuple, normalize.resolve(made, s).select("file_id", "seq", "timestamp", "time_source", "read_at").collect())) for s in ((), shifts))
    assert whole == parts and {r[3] for r in parts} == {"none", "carried", "assumed", "offset"}


def test_no_task_holds_a_file(spark):
    plan = normalize.resolve(entries(spark, 1), scan.LINES)._jdf.queryExecution().executedPlan().toString()
    keys = [p.split("hashpartitioning(")[1].split(")")[0] for p in plan.splitlines() if "hashpartitioning(" in p]
    assert "SinglePartition" not in plan and keys and sum("_block" in k for k in keys) >= len(keys) - 2  # totals of a file's blocks meet for its earliest stamp


def clocks_of(spark, n: int, seed: int):
    rng, rows = random.Random(seed), []
    for i in range(n):
        first = dt.datetime(1969, 6, 1) + dt.timedelta(seconds=rng.randrange(2 * 10**9))
        rows.append((i, f"f{i}", None, None) if i % 97 == 5 else (i, f"f{i}", first, first + dt.timedelta(seconds=rng.choice([0, 5, 10**5]))))
    rows += [(n + i, f"f{n + i}", dt.datetime(2031, 1, 1), dt.datetime(2031, 1, 1)) for i in range(3)]  # equal windows
    return rows, spark.createDataFrame(rows, "file_idx int, file_id string, first timestamp_ntz, last timestamp_ntz")


def all_pairs(rows) -> dict[int, float | None]:
    dated = [r for r in rows if r[2]]
    return {r[0]: min((max(0, (o[2] - r[3]).total_seconds(), (r[2] - o[3]).total_seconds()) for o in dated if o[0] != r[0]), default=None) if r[2] else None for r in rows}


@pytest.mark.parametrize("n,shifts", [(0, scan.MICROS), (40, (40, 48, 63)), (5000, scan.MICROS)])
def test_skew_of_many_files(spark, n, shifts):
    rows, clocks = clocks_of(spark, n, 3)
    found = normalize.skew_of_many(clocks, shifts=shifts)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    expected = all_pairs(rows)
    got = {r.file_idx: r for r in found.collect()}
    assert got.keys() == expected.keys()
    for i, gap in expected.items():
        assert (got[i].gap_seconds is None) == (gap is None) and (gap is None or abs(got[i].gap_seconds - gap) < 1e-3)
        assert (got[i].skew_warning is not None) == (gap is not None and gap > 120)


def test_skew_of_one_and_few(spark):
    one = spark.createDataFrame([(0, "f0", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))], "file_idx int, file_id string, first timestamp_ntz, last timestamp_ntz")
    assert [r.gap_seconds for r in normalize.skew_of_many(one).collect()] == [None] == [r.gap_seconds for r in normalize.detect_skew(one).collect()]
    rows, clocks = clocks_of(spark, 30, 9)
    few, many = (sorted((r.file_idx, r.gap_seconds, r.skew_warning) for r in f(clocks).collect()) for f in (normalize.detect_skew, normalize.skew_of_many))
    assert few == many


@pytest.mark.parametrize("how,fold_of", [("sum", sum), ("max", max), ("min", min), ("last", lambda v: v[-1])])
def test_before(spark, how, fold_of):
    rng = random.Random(7)
    rows = [(k, p, s, rng.choice([None, rng.randrange(100)])) for k in "ab" for p in rng.sample(range(300), 40) for s in range(rng.choice([1, 2]))]
    df = spark.createDataFrame(rows, "k string, p long, s int, v int")
    got = scan.before(df, ["k"], "p", {"x": (F.col("v"), how)}, order=["s"], shifts=(2, 5, 63), overall={"n": (F.col("v"), "sum")}).collect()
    assert len(got) == len(rows)
    for r in got:
        earlier = [v for k, p, s, v in sorted(rows, key=lambda y: y[:3]) if k == r.k and (p, s) < (r.p, r.s) and v is not None]
        assert r.x == (fold_of(earlier) if earlier else None) and r.n == sum(v for k, _, _, v in rows if k == r.k and v is not None)


def test_lines_of_a_folder_end_as_those_of_a_batch(spark, tmp_path):
    from tidemark.sources.bulk import lines_below
    from tidemark.sources.files import file_set, lines_of

    text = "a\nb\r\nc\rd\x0be\x0cf\x85g h\n\n\x1di\n  \nj"
    (tmp_path / "x.log").write_bytes(text.encode())
    batch = lines_of(file_set(spark, [{"name": "x.log", "content": text}])).collect()
    assert sorted(map(tuple, lines_below(spark, str(tmp_path)).select("line_no", "line").collect())) == sorted(map(tuple, batch))
