"""Every deterministic query against its SQL form, at the scale the SQL assumes column kinds for."""

import pytest

from tabscout.plans import evaluation, modelling, profiling, shaping  # noqa: F401
from tabscout.plans.registry import ORACLES, QUERIES
from tests.compare import compare, duck

# Queries of the modelling module that fit models are exercised in their own tests.
FITTED = {n for n, q in QUERIES.items() if q.__module__ == "tabscout.plans.modelling"}
TABLE_ONLY = {"eligible_targets", "score_targets", "grade_targets", "rate_datasets", "suggest_exclusions", "leak_suspect",
              "rank_runs", "best_run", "class_focus", "idea_candidates", "feature_vector"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in FITTED or n in TABLE_ONLY))
def test_query_matches_sql(spark, sf_dir, con, name):
    text, ok = compare(spark, sf_dir, name, QUERIES[name], ORACLES[name], con)
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
