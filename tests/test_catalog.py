import pytest

import __spark_entry__  # noqa: F401  (its plans register their queries)
from shoal.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLES[name])


def test_queries_without_sql_are_held_elsewhere():
    """test_brute.py holds each of them against a sequential version."""
    assert set(QUERIES) - set(ORACLES) == {"clu_merge_sets", "join_eye_candidates", "lim_buffer_fill", "lim_low_water", "mat_both_eyes", "mat_pair_eyes", "mat_report", "smp_units", "win_settle"}
