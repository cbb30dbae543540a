"""Queries that take the whole of what the analysis takes."""

import os

import pytest

from isohyet.plans import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_k_choice_sweeps_all_ks(spark, monkeypatch):
    asked, swept = [], Q.swept
    monkeypatch.setattr(Q, "swept", lambda s, d, ks: asked.extend(ks) or swept(s, d, ks))
    assert Q.k_choice(spark, DATA).count() > 0
    assert asked == list(range(2, 15))


def test_surrogate_rank_test_takes_99_and_all_metrics(spark):
    rows = Q.surrogate_rank_test(spark, DATA).collect()
    assert {r.metric for r in rows} == {"det", "lam", "entr", "lmean"}
    assert min(r.p for r in rows) >= 0.01 - 1e-12
    assert all(abs(r.p * 100 - round(r.p * 100)) < 1e-9 for r in rows)
    assert any(round(r.p * 100) % 5 for r in rows)
