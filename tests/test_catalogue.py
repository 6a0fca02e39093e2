"""Every incident query against its SQL, and the rows of those that SQL can't express."""

import pytest

from blamegrid.plans import catalogue

from .duck import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name], SF)


def test_out_of_fold_ranks_every_candidate_once(spark):
    rows = catalogue.oof_fit_predict(spark, SF).toPandas()
    assert len(rows) == 18 * 13
    assert all(sorted(own) == [*range(1, 14)] for _, own in rows.groupby("case_id")["rank"])
    assert (rows.groupby("case_id")["fold"].nunique() == 1).all()


def test_replay_passes(spark):
    row = catalogue.model_replay(spark, SF).first()
    assert row["passed"] and row["state_valid"]


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 18 * 13
    assert set(entry.oracle_sql()) <= set(entry.queries())
