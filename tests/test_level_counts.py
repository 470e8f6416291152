"""Stamps are carried over the whole of a file, however many events it has."""

import duckdb

from tidemark import queries


def test_files_are_not_cut_where_stamps_are_carried(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(queries, "PER_FILE", 10)
    with duckdb.connect() as con:
        con.execute(f"create view events as select * from '{folder}/events.parquet'")
        expected = con.execute(queries.ORACLES["level_counts"]).fetchall()
    assert sorted(tuple(r) for r in queries.QUERIES["level_counts"](spark, folder).collect()) == sorted(expected)
