"""Growing files are read once each line, whatever the ranges and wherever a file ended for a while."""

from __future__ import annotations

import pytest
from tidemark.sources.bulk import lines_below
from tidemark.sources.tail import Span, TailReader, TailStream, _Files, growing_lines, register
from tidemark.streaming import files

TEXT = "one\n\ntwo ü\r\n" + "x" * 50 + "\nlast more\n\nno end"


def read_all(reader, spans):
    return [(r["line_no"], r["line"]) for s in spans for b in reader.read(s) for r in b.to_pylist()]


@pytest.mark.parametrize("split", [1, 2, 3, 7, 1000])
def test_ranges_of_any_size_give_each_line_once(tmp_path, split):
    for text in (TEXT, TEXT + "\n", "\n", "\n\n\n", "a", "﻿" + "ab\n" * 9):
        raw = text.encode()
        (tmp_path / "a.log").write_bytes(raw)
        reader = TailReader({"path": str(tmp_path), "splitBytes": str(split)})
        want, at = [], 0
        for piece in raw.split(b"\n")[: None if not raw.endswith(b"\n") else -1]:
            want.append((at, piece.decode()))
            at += len(piece) + 1
        assert read_all(reader, reader.partitions()) == want


def test_lines_longer_than_what_is_read_at_a_time(tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.sources.tail.BATCH_BYTES", 4)
    (tmp_path / "a.log").write_text("short\n" + "y" * 99 + "\nz\n\n" + "w" * 30)
    for split in (1, 5, 40, 1000):
        reader = TailReader({"path": str(tmp_path), "splitBytes": str(split)})
        assert read_all(reader, reader.partitions()) == [(0, "short"), (6, "y" * 99), (106, "z"), (108, ""), (109, "w" * 30)]


def test_a_file_that_is_shorter_than_listed(tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo")
    for end in (7, 8, 500):
        assert read_all(TailReader({"path": str(tmp_path)}), [Span(str(tmp_path / "a.log"), 0, 0, end)]) == [(0, "one"), (4, "two")]


def test_invalid_bytes_and_empty_files(tmp_path):
    (tmp_path / "b.log").write_bytes(b"\xff\xfe\nok\n")
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x\n")
    reader = TailReader({"path": str(tmp_path)})
    assert read_all(reader, reader.partitions()) == [(0, "��"), (3, "ok")]
    assert read_all(TailReader({"path": str(tmp_path / "none")}), [Span("", 0, 0, 0)]) == []


def test_the_end_of_the_last_whole_line(tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.sources.tail.BACK_BYTES", 3)
    path, stream, grown = tmp_path / "a.log", TailStream({"path": str(tmp_path), "splitBytes": "4"}), b""
    place, lines = {}, []
    for piece in (b"abc", b"defghijk\nl", b"m\n", b"n", b"o", b"\n\np\n"):
        grown += piece
        path.write_bytes(grown)
        now = stream.latestOffset()
        assert now[str(path)] == grown.rfind(b"\n") + 1
        lines += read_all(stream, stream.partitions(place, now))
        place = now
    assert [t for _, t in lines] == ["abcdefghijk", "lm", "no", "", "p"]
    with pytest.raises(ValueError, match="shorter"):
        stream.partitions(place, {str(path): 1})
    assert _Files({"path": str(tmp_path)}).split_bytes == 64 << 20


def test_a_batch_has_the_lines_of_the_text_source(spark, tmp_path):
    for n in ("a", "b", "c"):
        (tmp_path / f"{n}.log").write_text(f"{n} first\n\n  at x\n{n} last")
    register(spark)
    read = spark.read.format("tidemark_tail").option("path", str(tmp_path)).option("splitBytes", "5").load()
    told = lambda df: sorted((r.name, r.line) for r in df.filter("line rlike '\\\\S'").collect())
    assert told(read) == told(lines_below(spark, str(tmp_path)))
    assert {r[0] for r in told(read.filter("name = 'b.log'"))} == {"b.log"} and {r[0] for r in told(read.filter("name in ('a.log', 'c.log')"))} == {"a.log", "c.log"}
    kept = TailReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert list(kept.pushFilters([EqualTo(("name",), "b.log"), GreaterThan(("line_no",), 1)])) == [GreaterThan(("line_no",), 1)]
    assert {s.file_id.rsplit("/", 1)[-1] for s in kept.partitions()} == {"b.log"}


def test_a_growing_folder_is_folded_across_restarts(spark, tmp_path):
    logs, out, marks = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "marks")
    logs.mkdir()
    texts = {n: "".join(f"2024-03-01T00:00:{i:02}Z ERROR {n} event {i}\n" + "    at x.Y\n" * (i % 3) for i in range(12)) for n in ("a", "b")}
    with files.state_store(spark):
        for part in (0.3, 0.31, 0.8, 1):
            for n, text in texts.items():
                (logs / f"{n}.log").write_text(text[: int(len(text) * part)])
            events = files.fold_stream(growing_lines(spark, str(logs), "plain", 50), {"plain"}, None)
            query = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
    got = sorted((r.service, r.raw) for r in spark.read.parquet(out).collect())
    want = [(n, f"2024-03-01T00:00:{i:02}Z ERROR {n} event {i}" + "\n    at x.Y" * (i % 3)) for n in texts for i in range(11)]  # the last is open
    assert got == sorted(want)
