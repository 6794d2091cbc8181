"""Registered queries run with the operators' full grids, rounds and folds."""

from __future__ import annotations

import inspect

import __spark_entry__ as entry
import pytest
from moodloom.operators import models as md

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def test_sweep_pipeline_runs_all_gammas_and_windows(spark):
    rows = QUERIES["sweep_pipeline"](spark, SF).select("experiment", "param").collect()
    assert sorted(map(tuple, rows)) == [("gamma", 1.0), ("gamma", 2.0), ("gamma", 3.0), ("sent_ma", 5.0), ("sent_ma", 10.0), ("sent_ma", 20.0)]


@pytest.mark.parametrize("name, operator, full", [
    ("gbt_compare", "gbt_compare", {"rounds": 300}), ("ts_cv", "ts_cv", {"rounds": 500, "k": 5}),
    ("feature_importance", "feature_importance", {"rounds": 500, "k": 5})])
def test_tree_queries_run_all_rounds_and_folds(spark, monkeypatch, name, operator, full):
    signature, seen = inspect.signature(getattr(md, operator)), {}

    class Called(Exception):
        pass

    def record(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Called

    monkeypatch.setattr(md, operator, record)
    with pytest.raises(Called):
        QUERIES[name](spark, SF)
    assert {k: seen[k] for k in full} == full
