"""Numbers as C prints them: the exact value of a double decides, halves go to the even neighbour."""

from pyspark.sql import functions as F

from tidemark.functions.text import fixed
from tidemark.plans import cost


def test_decimals_are_those_of_c(spark):
    values = [92.5, 93.5, 185.065, 1.25, 1.35, 1.05, 0.15, 0.125, 0.375, 2.5, 0.5, 1.5, 0.0, 0.99995, 0.00005, 0.00015, 9.995, 99.995, 123456.785, 1e10 / 3, -2.675, -0.5, 3e-310]
    values += [k * 0.00037013 for k in range(0, 1_000_000, 12_500)] + [k / 8 for k in range(400)] + [k / 1000 + 0.0005 for k in range(1500)]
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", *[fixed(F.col("x"), d).alias(f"d{d}") for d in range(5)]).collect()
    for r in rows:
        for d in range(5):
            assert r[f"d{d}"] == f"{r.x:.{d}f}", (r.x, d)
    assert spark.range(1).select(fixed(F.lit(None).cast("double"), 2).alias("x")).first().x is None


def test_cheaper_by_half_an_odd_number(spark):
    assert spark.range(1).select(cost.relative_text(F.lit(2.0), F.lit(185.0), F.lit(False)).alias("t")).first().t == "92× cheaper"


def test_dollars_at_a_half(spark):
    rows = spark.createDataFrame([(500_000,)], "n long").select(cost.usd_text(F.col("n") * F.lit(0.00037013)).alias("u"), cost.tokens_text(F.lit(1250)).alias("t"))
    assert tuple(rows.first()) == ("$185.06", "1.2k")
