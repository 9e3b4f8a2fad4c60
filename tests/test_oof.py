"""Out-of-fold training contract: row sets, leak-freedom, smoke quality gate."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from foldwise.plans import oof as OOF
from foldwise.plans.trainers import get_trainer
from foldwise.sources import tasks as T


@pytest.fixture(scope="module")
def syn(spark):
    t = T.with_planted_features(T.syn_task(spark, SF_MID))
    spec = replace(T.SPECS["syn"], te_cols=("user_id",))
    return t, spec


def test_binary_oof_contract_and_smoke_gate(spark, syn):
    t, spec = syn
    run = OOF.run_oof(spark, t, spec, get_trainer("linear"), ["value", "s_a", "s_n"])
    oof = OOF.oof_table(run)
    train_ids = T.train_rows(t).select("id")
    assert oof.columns == ["id", "oof"]
    assert oof.select("id").exceptAll(train_ids).count() == 0 and train_ids.exceptAll(oof.select("id")).count() == 0
    assert len(run.cv_scores) == 5 and min(run.cv_scores) > 0.8          # planted signal, as the reference gate
    assert run.test.count() == T.test_rows(t).count()
    assert run.cv_label == "StratifiedKFold_5"


def test_screening_run_writes_no_oof(spark, syn):
    t, spec = syn
    run = OOF.run_oof(spark, t, spec, get_trainer("linear"), ["value", "s_a", "s_n"], max_folds=2)
    assert run.oof is None and len(run.cv_scores) == 2 and run.cv_label == "StratifiedKFold_5_partial2"
    with pytest.raises(ValueError):
        OOF.oof_table(run)


def test_augmentation_weight_needs_weight_support(spark, syn):
    t, spec = syn
    tr = get_trainer("linear")
    tr.supports_weight = False
    with pytest.raises(ValueError):
        OOF.run_oof(spark, t, spec, tr, ["value"], aug_weight=0.5)


def test_multiclass_oof_shape(spark):
    t, spec = T.load_task(spark, SF_SMALL, "vec")
    run = OOF.run_oof(spark, t, spec, get_trainer("linear", regParam=0.01), [], vector_col="embedding")
    wide = OOF.oof_table(run)
    assert wide.columns == ["id"] + [f"oof_{c}" for c in run.label_map.classes]
    probs = OOF.test_prob_table(run)
    s = probs.select(sum(F.col(f"`{c}`") for c in probs.columns[1:]).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert abs(s[0] - 1) < 1e-6 and abs(s[1] - 1) < 1e-6


def test_unknown_trainer_lists_known():
    with pytest.raises(ValueError, match="gbt"):
        get_trainer("catboost")


def test_fold_input_fingerprints_are_reproducible_and_sensitive(spark, syn):
    from foldwise.operators.integrity import fingerprint_diff

    t, spec = syn
    a = OOF.run_oof(spark, t, spec, get_trainer("linear"), ["value", "s_a"], max_folds=2, capture_inputs=True)
    b = OOF.run_oof(spark, t, spec, get_trainer("linear"), ["value", "s_a"], max_folds=2, capture_inputs=True)
    assert fingerprint_diff(a.input_fingerprints, b.input_fingerprints, ["fold", "role"]).count() == 0
    assert a.input_fingerprints.count() == 6  # 2 folds x (fit, valid, predict)
    c = OOF.run_oof(spark, t, replace(spec, te_smoothing=5.0), get_trainer("linear"), ["value", "s_a"],
                    max_folds=2, capture_inputs=True)
    changed = fingerprint_diff(a.input_fingerprints, c.input_fingerprints, ["fold", "role"]).count()
    assert changed == 6  # the encoding enters every role


def test_save_models_and_row_count_check(spark, syn, tmp_path):
    from foldwise.operators.integrity import check_row_count
    from foldwise.session import scratch_path

    t, spec = syn
    run = OOF.run_oof(spark, t, replace(spec, te_cols=()), get_trainer("linear"), ["value"], max_folds=1)
    root = scratch_path(spark, "models")
    OOF.save_models(run.models, root, "exp_x")
    from pyspark.ml.classification import LogisticRegressionModel
    assert LogisticRegressionModel.load(f"{root}/exp_x_fold0").numFeatures == 1
    src = t.where("part = 'source'")
    n = src.count()
    assert check_row_count(src, n, "source") == n
    with pytest.raises(ValueError):
        check_row_count(src, n + 1, "source")


def test_group_task_uses_group_inner_folds(spark):
    t = T.with_planted_features(T.bin_task(spark, SF_SMALL))
    spec = replace(T.SPECS["grp"])
    run = OOF.run_oof(spark, t, spec, get_trainer("linear"), ["value", "s_a"], max_folds=1)
    assert run.cv_label == "GroupKFold_5_partial1" and len(run.cv_scores) == 1
