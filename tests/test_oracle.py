"""Spark queries equal their DuckDB oracle on the smallest driver tables."""

import pytest

from conftest import SF_SMALL

CORE = [
    "stratified_folds", "kfold", "group_folds", "te_oof_train", "te_valid", "te_apply_test", "te_regression",
    "auc_by_fold", "logloss_by_fold", "mc_logloss", "balanced_accuracy", "past_mean", "past_std", "group_lag",
    "group_cumcount", "rank_mean", "category_vocab", "num_hist_by_class", "profile", "member_matrix",
    "id_align_check", "oof_corr", "mc_blend_equal", "meta_oof", "log_table", "fold_noise", "regime_check",
    "split_check", "fold_fingerprint", "fingerprint_diff", "submission",
]


@pytest.fixture(scope="module")
def duck():
    from oracle_check import open_duckdb

    return open_duckdb(SF_SMALL)


@pytest.mark.parametrize("name", CORE)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from oracle_check import compare

    err = compare(E.queries()[name](spark, SF_SMALL), duck, E.oracle_sql()[name])
    assert err is None, err


def test_every_oracle_has_a_query():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["id", "oof"]
    assert df.count() > 0
