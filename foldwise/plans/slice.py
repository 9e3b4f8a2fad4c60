"""Minimum slice: does a user's leak-free purchase rate predict a purchase?

events -> stratified folds on y = (event_type = 'purchase') -> validation
encoding of user_id with the map of the other folds -> OOF table [id, oof]
-> AUC per fold -> CV summary. In this data the label does not depend on
the user, so AUC near 0.5 is the correct (leak-free) answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators import folds as FO
from foldwise.operators import metrics as M
from foldwise.operators.encode import fit_target_encoding
from foldwise.sources import tasks as T


def minimum_slice(spark: SparkSession, sf_dir: str):
    task, spec = T.load_task(spark, sf_dir, "bin")
    folded = FO.assign_folds(T.train_rows(task), spec)
    enc = fit_target_encoding(folded, ["user_id"], spec.n_folds, smoothing=spec.te_smoothing, seed=spec.seed)
    valid = enc.valid(folded)
    oof = valid.select("id", "fold", "y", F.col("user_id_te").alias("oof"))
    fold_auc = M.auc(oof, ["fold"], p="oof", out="score")
    return oof, fold_auc


def minimum_slice_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    oof, _ = minimum_slice(spark, sf_dir)
    return oof.select("id", F.round("oof", 6).alias("oof"))
