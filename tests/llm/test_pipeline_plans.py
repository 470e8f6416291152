"""What a stage of the pipeline returns is run by its caller, whose batches may be large: no Python is left in it."""

from types import SimpleNamespace

import pytest

import corpus_pipeline
from tidemark.llm import jaccard
from tidemark.llm.common import table

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["quality_rules", "mix_sources"])
def test_stages_leave_no_python_step_to_their_caller(spark, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, table(spark, SF, "documents"), SF)
    assert out.columns == table(spark, SF, "documents").columns and out.limit(1).count() == 1
    assert "InArrow" not in plan_of(out) and "Python" not in plan_of(out)


def test_links_begin_empty_without_python_workers(spark):
    links = jaccard.Links(SimpleNamespace(df=table(spark, SF, "documents")))
    for df, columns in ((links.found, "u v"), (links.roots, "node root"), (links.sets, "node n shingles")):
        assert df.columns == columns.split() and df.count() == 0
        assert "ExistingRDD" not in plan_of(df)
