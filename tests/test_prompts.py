"""Transcripts that are cut keep exactly so many characters of both ends, wherever the cut falls."""

import datetime as dt

from tidemark.plans import prompts


def test_a_cut_at_the_end_of_a_line_keeps_the_line_end(spark):
    start, texts = dt.datetime(2025, 1, 1), ["m" * (i % 7) for i in range(40)]
    rows = [("f0", i, 0, start + dt.timedelta(seconds=i), "info", "s", t) for i, t in enumerate(texts)]
    entries = spark.createDataFrame(rows, "file_id string, line_no int, seq int, timestamp timestamp_ntz, level string, service string, message string").cache()
    body = "\n".join(f"{r[3].isoformat()}+00:00 INFO     s: {r[6]}" for r in rows)
    ends = {i for i, c in enumerate(body) if c == "\n"}
    halves = [h for h in range(100, 180) if h - 1 in ends or len(body) - h in ends]
    assert {h - 1 in ends for h in halves} == {len(body) - h in ends for h in halves} == {True, False}
    for half in halves:
        cut = f"{body[:half]}\n\n… [{len(body) - 2 * half:,} characters of the middle omitted] …\n\n{body[-half:]}"
        assert prompts.transcript(entries, "file_id", max_chars=2 * half).first().prompt == cut
