"""A format of a user's own, and coverage cubes with sketches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tidemark import formats, queries
from tidemark.operators import report
from tidemark.plans.ingest import ingest, ingest_folder
from tidemark.sources.files import file_set

BARS = "".join(f"@2024-03-01T00:00:{i:02d}Z|error|cart|step {i}\n  frame {i}\n" for i in range(20))
LOGFMT = "".join(f"ts=2024-03-01T00:00:{i:02d}Z level=info msg=m{i} a=1\n" for i in range(20))


def test_a_ninth_format(spark, tmp_path):
    files = [{"name": "x.log", "content": "junk before\n" + BARS}, {"name": "y.log", "content": LOGFMT}]
    (tmp_path / "x.log").write_text(BARS)
    with formats.registered(queries.added_format()):
        result = ingest(file_set(spark, files), year=2024)
        declared = ingest(file_set(spark, [{"name": "z", "content": BARS, "format": "bars"}]), year=2024)
        folder = ingest_folder(spark, str(tmp_path), year=2024)
    assert not formats.ADDED
    found = {r.name: (r.format, r.entry_count) for r in result.files.collect()}
    assert found == {"x.log": ("bars", 21), "y.log": ("logfmt", 20)}
    entries = result.timeline.filter("file_id = 'f0' and service = 'cart'").collect()
    assert len(entries) == 20 and {e.level for e in entries} == {"error"} and entries[3].message == "step 3\nframe 3" and entries[3].time_source == "offset"
    assert declared.entries.filter("service = 'cart'").count() == 20 == folder.entries.filter("service = 'cart'").count()
    assert ingest(file_set(spark, files[:1]), year=2024).files.first().format == "plain"


def test_names_and_patterns_of_formats():
    for wrong in (("json", "(a)", 1), ("Two Words", "(a)", 1), ("x", "(a)", 2)):
        with pytest.raises(ValueError):
            formats.Format(*wrong, lambda g: g)
    with pytest.raises(ValueError), formats.registered():
        file_set(None, [{"name": "a", "content": "", "format": "bars"}])


def test_cubes_merge_and_count(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["db", "api"]), rng.choice(["info", "error"]), rng.choice([None, f"t{rng.randrange(3000)}"]), {"k": "v"} if i % 3 else {}) for i in range(6000)]
    entries = spark.createDataFrame(rows, "service string, role string, level string, trace_id string, correlation_keys map<string,string>")
    whole = report.coverage_cube(entries)
    halves = report.merged_cube(report.coverage_cube(entries.filter("role = 'db'")).unionByName(report.coverage_cube(entries.filter("role = 'api'"))))
    counted = ["service", "role", "level", "grouped", "n", "with_trace_id", "with_correlation_key", F.hll_sketch_estimate("traces").alias("traces")]
    one, two = ({r[:4]: r[4:] for r in map(tuple, c.select(*counted).collect())} for c in (whole, halves))
    assert one.keys() == two.keys() and len(one) == 4 * 3 * 3
    for key, (n, traced, keyed, estimate) in one.items():
        mine = [r for r in rows if all(key[3] >> (2 - i) & 1 or r[i] == key[i] for i in range(3))]
        exact = len({r[3] for r in mine if r[3]})
        assert (n, traced, keyed) == (len(mine), sum(r[3] is not None for r in mine), sum(bool(r[4]) for r in mine)) == two[key][:3]
        assert abs(estimate - exact) <= 5 * 0.013 * exact + 1 and abs(two[key][3] - exact) <= 5 * 0.013 * exact + 1
    assert report.coverage_cube(entries.limit(0)).filter("grouped < 7").collect() == []
