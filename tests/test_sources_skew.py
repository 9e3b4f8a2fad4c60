"""File sources, and nested encoding against brute force with a hot category."""

import numpy as np
import pandas as pd

from foldwise.operators.encode import fit_target_encoding
from foldwise.operators.folds import rank_folds
from foldwise.sources.files import read_pred, read_task_table


def test_csv_task_scan_and_prediction_files(spark, tmp_path):
    from pyspark.sql import types as T

    p = tmp_path / "train.csv"
    p.write_text("id,cat,x,target\n1,a,1.5,1\n2,b,NaN,0\n3,,2.0,1\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("cat", T.StringType()),
                           T.StructField("x", T.DoubleType()), T.StructField("target", T.IntegerType())])
    df = read_task_table(spark, str(p), schema, categorical=["cat", "absent"])
    rows = {r["id"]: r for r in df.collect()}
    assert rows[2]["x"] is None and rows[3]["cat"] is None and rows[1]["x"] == 1.5
    d = tmp_path / "oof"
    d.mkdir()
    (d / "m1.csv").write_text("id,oof\n1,0.25\n2,0.75\n")
    spark.createDataFrame([(1, 0.5)], "id long, oof float").write.parquet(str(d / "m2.parquet"))
    assert sorted(r["oof"] for r in read_pred(spark, str(d), "m1").collect()) == [0.25, 0.75]
    m2 = read_pred(spark, str(d), "m2")
    assert dict(m2.dtypes)["oof"] == "double" and m2.first()["oof"] == 0.5


def _brute_force(pdf, n_folds, n_inner, smoothing):
    """Direct nested computation, one outer fold and one inner fold at a time."""
    out = {}
    for k in range(n_folds):
        tr = pdf[pdf.fold != k]
        prior = tr.y.mean()
        for j in range(n_inner):
            inner_tr = tr[tr[f"j{k}"] != j]
            agg = inner_tr.dropna(subset=["c"]).groupby("c").y.agg(["sum", "count"])
            for _, r in tr[tr[f"j{k}"] == j].iterrows():
                if pd.isna(r.c) or r.c not in agg.index:
                    out[(r.id, k)] = prior
                else:
                    s, n = agg.loc[r.c]
                    out[(r.id, k)] = (s + prior * smoothing) / (n + smoothing)
    return out


def test_nested_encoding_with_a_hot_category_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 300
    cats = np.where(np.arange(n) % 3 == 0, "hot", np.array([f"c{i % 17}" for i in range(n)], dtype=object))
    cats[rng.choice(n, 7, replace=False)] = None
    y = (rng.random(n) < np.where(cats == "hot", 0.7, 0.3)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "y": y, "c": cats}))
    folded = rank_folds(df, 5, seed=42, strata="y")
    enc = fit_target_encoding(folded, ["c"], 5, smoothing=20.0, n_inner=5, seed=42)
    got = enc.train.select("id", "k", "j", "c_te").toPandas()
    f = folded.toPandas()
    # take the inner folds the Spark job assigned, then recompute every encoding directly
    for k in range(5):
        jk = got[got.k == k].set_index("id").j
        f[f"j{k}"] = f.id.map(jk)
    want = _brute_force(f, 5, 5, 20.0)
    assert len(got) == len(want) == 4 * n
    for r in got.itertuples():
        assert abs(r.c_te - want[(r.id, r.k)]) < 1e-12
    # inner folds are stratified within each outer train part
    for k in range(5):
        part = got[got.k == k].merge(f[["id", "y"]], on="id")
        sizes = part.groupby(["y", "j"]).size().unstack()
        assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1
