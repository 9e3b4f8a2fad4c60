"""Trainer adapters over Spark ML estimators, registered by name.

A trainer turns (train part, optional validation part) into a fitted
model and a model into predictions: ``p`` (binary probability or
regression value) or ``probs`` (array of K class probabilities).
Differences to native GBT libraries that cannot be hidden: Spark trees do
not take missing values (features are filled and flagged before assembly),
GBT takes several classes as one model per class, and with early stopping all
rounds are fitted before the validation loss after each of them decides which
are kept. Tree binning samples rows in partition order, so
tree models can differ in the last digits between runs after a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATIENCE = 50  # rounds without a better validation loss


@dataclass
class Trainer:
    name: str
    supports_weight: bool = True
    params: dict = field(default_factory=dict)
    problem_types = ("binary", "regression", "multiclass")

    def estimator(self, problem_type: str, seed: int, weight_col: str | None, validation_col: str | None):
        raise NotImplementedError

    def fit(self, df: DataFrame, problem_type: str, seed: int = 42, weight_col: str | None = None,
            validation_col: str | None = None, max_categories: int = 0):
        est = self.estimator(problem_type, seed, weight_col, validation_col)
        if est.hasParam("maxBins"):  # a nominal feature needs a bin for each of its values
            est = est.copy({est.getParam("maxBins"): max(est.getOrDefault("maxBins"), max_categories)})
        return est.fit(df)

    def predict(self, model, df: DataFrame, problem_type: str, n_classes: int | None = None) -> DataFrame:
        out = model.transform(df)
        if problem_type == "regression":
            return out.withColumn("p", F.col("prediction"))
        arr = vector_to_array("probability")
        if problem_type == "binary":
            return out.withColumn("p", F.element_at(arr, 2))
        k = n_classes or 0
        return out.withColumn("probs", F.array(*[F.coalesce(F.get(arr, F.lit(i)), F.lit(0.0)) for i in range(k)]))

    def metadata(self, model) -> dict:
        return {}


def best_round(losses, patience: int) -> int:
    """1-based round of the least loss, looking no further than ``patience`` rounds past the last
    improvement; all rounds if no loss is a number."""
    best = None
    for i, x in enumerate(losses):
        if x == x and (best is None or x < losses[best]):
            best = i
        elif best is not None and i - best >= patience:
            break
    return len(losses) if best is None else best + 1


def first_rounds(model, rounds: int):
    """A boosted model of the first ``rounds`` trees of ``model``."""
    java, sc = model._java_obj, SparkContext._active_spark_context
    ml = sc._jvm.org.apache.spark.ml
    trees, weights = java.trees(), java.treeWeights()
    kept = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, rounds)
    kept_weights = sc._gateway.new_array(sc._jvm.double, rounds)
    for i in range(rounds):
        kept[i], kept_weights[i] = trees[i], weights[i]
    name = type(model).__name__
    package = ml.regression if name.endswith("RegressionModel") else ml.classification
    short = type(model)(getattr(package, name)(java.uid(), kept, kept_weights))
    short._resetUid(model.uid)
    for param, value in model.extractParamMap().items():
        short._set(**{param.name: value})
    return short


class GBTTrainer(Trainer):
    """Boosted trees; several classes by one model per class, probabilities normalised.

    With a validation part the loss on it is taken after every round, and the model keeps its
    rounds up to the best one (``patience`` rounds without improvement end the search).
    """

    def estimator(self, problem_type, seed, weight_col, validation_col):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.regression import GBTRegressor

        kw = dict(featuresCol="features", labelCol="label", seed=seed, maxIter=self.params.get("maxIter", 30),
                  maxDepth=self.params.get("maxDepth", 4), stepSize=self.params.get("stepSize", 0.2))
        if weight_col:
            kw["weightCol"] = weight_col
        return (GBTClassifier if problem_type == "binary" else GBTRegressor)(**kw)

    def fit(self, df, problem_type, seed=42, weight_col=None, validation_col=None, max_categories=0):
        if problem_type != "multiclass":
            return self._fit_one(df, problem_type, seed, weight_col, validation_col, max_categories)
        rows = df.where(~F.col(validation_col)) if validation_col else df
        classes = sorted(int(r[0]) for r in rows.select("label").distinct().collect())
        return {c: self._fit_one(df.withColumn("label", (F.col("label") == c).cast("double")), "binary", seed, weight_col,
                                 validation_col, max_categories) for c in classes}

    def _fit_one(self, df, problem_type, seed, weight_col, validation_col, max_categories):
        if not validation_col:
            return super().fit(df, problem_type, seed, weight_col, None, max_categories)
        model = super().fit(df.where(~F.col(validation_col)), problem_type, seed, weight_col, None, max_categories)
        held = df.where(F.col(validation_col))
        losses = model.evaluateEachIteration(held, "squared") if problem_type == "regression" else model.evaluateEachIteration(held)
        return first_rounds(model, best_round(losses, self.params.get("patience", PATIENCE)))

    def predict(self, model, df, problem_type, n_classes=None):
        if problem_type != "multiclass":
            return super().predict(model, df, problem_type, n_classes)
        out = df
        for c, m in model.items():
            scored = m.transform(out)
            out = scored.withColumn(f"_p{c}", F.element_at(vector_to_array("probability"), 2)).drop(
                "rawPrediction", "probability", "prediction")
        one = [F.col(f"_p{i}") if i in model else F.lit(0.0) for i in range(n_classes or 0)]
        total = sum(one, F.lit(0.0))
        return out.withColumn("probs", F.array(*[x / total for x in one]))

    def metadata(self, model) -> dict:
        models = model.values() if isinstance(model, dict) else [model]
        return {"best_iter": max(int(m.getNumTrees) for m in models)}


class RandomForestTrainer(Trainer):
    def estimator(self, problem_type, seed, weight_col, validation_col):
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.regression import RandomForestRegressor

        kw = dict(featuresCol="features", labelCol="label", seed=seed, numTrees=self.params.get("numTrees", 40),
                  maxDepth=self.params.get("maxDepth", 6))
        if weight_col:
            kw["weightCol"] = weight_col
        return (RandomForestRegressor if problem_type == "regression" else RandomForestClassifier)(**kw)


class LinearTrainer(Trainer):
    def estimator(self, problem_type, seed, weight_col, validation_col):
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.regression import LinearRegression

        kw = dict(featuresCol="features", labelCol="label", regParam=self.params.get("regParam", 0.0),
                  elasticNetParam=0.0, maxIter=self.params.get("maxIter", 100))
        if weight_col:
            kw["weightCol"] = weight_col
        if problem_type == "regression":
            return LinearRegression(**kw)
        return LogisticRegression(family="multinomial" if problem_type == "multiclass" else "binomial", **kw)


REGISTRY = {"gbt": GBTTrainer, "rf": RandomForestTrainer, "linear": LinearTrainer}


def get_trainer(name: str, **params) -> Trainer:
    if name not in REGISTRY:
        raise ValueError(f"unknown trainer {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](name=name, params=params)
