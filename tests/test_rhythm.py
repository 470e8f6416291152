"""Gaps, cadence, bursts and followers against plain Python."""

from __future__ import annotations

import bisect
import datetime as dt
import random
import statistics
from collections import defaultdict

import pytest
from tidemark.operators import rhythm, scan

SECOND = 1_000_000


def entries(seed: int, n: int = 900) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for _ in range(n):
        key = rng.choice(["hot", "hot", "a", "b", None])
        at = rng.choice([None, rng.randrange(-5000, 5000), rng.randrange(100), 77])
        ts = None if at is None else dt.datetime(1970, 1, 2) + dt.timedelta(seconds=at, microseconds=rng.choice([0, 1, 500]))
        rows.append((rng.choice(["s", "t"]), key, ts, at))
    return rows


def times(rows: list[tuple]) -> dict[tuple, list[int]]:
    out = defaultdict(list)
    for s, k, ts, _ in rows:
        if k and ts:
            out[s, k].append(round((ts - dt.datetime(1970, 1, 1)).total_seconds() * 10**6))
    return {k: sorted(v) for k, v in out.items()}


def frame(spark, rows):
    return rhythm.occurrences(spark.createDataFrame(rows, "service string, template_id string, timestamp timestamp_ntz, at int").repartition(3))


@pytest.mark.parametrize("shifts", [(4, 20, 63), scan.MICROS])
def test_gaps_and_bursts(spark, shifts):
    rows = entries(1)
    gapped, expected = rhythm.gaps(frame(spark, rows), shifts=shifts), times(rows)
    found = defaultdict(list)
    for r in gapped.collect():
        found[r.service, r.template_id].append((r.at, -1 if r.gap is None else r.gap))
    assert {k: sorted(g for _, g in v) for k, v in found.items()} == {k: sorted([-1] + [b - a for a, b in zip(v, v[1:], strict=False)]) for k, v in expected.items()}
    runs = set()
    for (s, k), at in expected.items():
        run = [at[0]]
        for t in [*at[1:], 10**18]:
            if t - run[-1] > 5 * SECOND:
                if len(run) >= 3:
                    runs.add((s, k, run[0], run[-1], len(run)))
                run = []
            run.append(t)
    assert runs and {tuple(r) for r in rhythm.bursts(gapped, 5 * SECOND, 3, shifts=shifts).collect()} == runs


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_quantiles_are_within_their_error(spark, accuracy):
    rows = entries(2, 3000)
    for r in rhythm.cadence(rhythm.gaps(frame(spark, rows)), accuracy=accuracy).collect():
        at = times(rows)[r.service, r.template_id]
        gaps = sorted(b - a for a, b in zip(at, at[1:], strict=False))
        assert (r.n, r.first, r["last"], r.shortest, r.longest) == (len(at), at[0], at[-1], gaps[0], gaps[-1])
        for p, got in ((0.1, r.p10), (0.5, r.p50), (0.9, r.p90)):
            low, high, slack = bisect.bisect_left(gaps, got), bisect.bisect_right(gaps, got), len(gaps) / accuracy + 1
            assert low - slack <= p * len(gaps) <= high + slack


def followed(rows: list[tuple], within: int, slot: int, unit: int) -> dict:
    firsts = {k: sorted({t // slot: t for t in reversed(v)}.values()) for k, v in times(rows).items()}
    out = {}
    for a, at in firsts.items():
        for b, bt in firsts.items():
            if a != b:
                lags = [x for x in (next((y - t for y in bt if y > t), within + 1) for t in at) if x <= within]
                if lags:
                    out[a + b] = (len(lags), len(at), statistics.median(x // unit * unit for x in lags))
    return out


@pytest.mark.parametrize("within,slot", [(60 * SECOND, SECOND), (5 * SECOND, 7 * SECOND)])
def test_followers_are_all_pairs_within_reach(spark, within, slot):
    rows = entries(3)
    pairs = rhythm.followers(frame(spark, rows), within, slot, 1000)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    found = {(r.a_service, r.a_template_id, r.b_service, r.b_template_id): (r.n, r["of"], r.median_lag) for r in pairs.collect()}
    assert found == followed(rows, within, slot, 1000)


def test_nothing(spark):
    none = frame(spark, [("s", None, None, 1), ("s", "a", None, 1)])
    gapped = rhythm.gaps(none)
    assert gapped.collect() == rhythm.cadence(gapped).collect() == rhythm.bursts(gapped, 1).collect() == rhythm.followers(none, 10, 1, 1).collect() == []


def test_quantiles_are_exact(spark):
    rows = entries(4, 3000)
    found = rhythm.cadence(rhythm.gaps(frame(spark, rows)), shifts=(8, 20, 63)).collect()
    assert len(found) == len(times(rows))
    for r in found:
        at = times(rows)[r.service, r.template_id]
        gaps = sorted(b - a for a, b in zip(at, at[1:], strict=False))
        assert (r.p10, r.p50, r.p90) == tuple(gaps[-(-len(gaps) * t // 10) - 1] for t in (1, 5, 9))


def test_quantiles_of_a_large_key_are_exact(spark):
    steps = [(i * 7919) % 30_011 + 1 for i in range(30_010)]
    at, rows = 0, []
    for s in steps:
        at += s
        rows.append(("s", "a", at))
    gapped = spark.createDataFrame([(*r, None if i == 0 else steps[i]) for i, r in enumerate(rows)], "service string, template_id string, at long, gap long")
    got, gaps = rhythm.cadence(gapped, shifts=(8, 20, 63)).first(), sorted(steps[1:])
    assert (got.p10, got.p50, got.p90) == tuple(gaps[-(-len(gaps) * t // 10) - 1] for t in (1, 5, 9))
