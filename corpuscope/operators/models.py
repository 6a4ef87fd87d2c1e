"""Classifiers and regressions on Spark ML."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel, LinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuscope.functions.hashing import hash_uniform
from corpuscope.operators import forest, metrics
from corpuscope.operators.features import assemble
from corpuscope.operators.isotonic import pooled_blocks
from corpuscope.operators.ordered import positions
from corpuscope.session import materialise

Scorer = Callable[[DataFrame], DataFrame]


def side_by_side(spark: SparkSession, tasks: Sequence[Callable]) -> list:
    """Results of tasks that start Spark jobs of their own, run at the same time: most rounds of a fit are too short
    to fill the executors."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]]


def with_features(df: DataFrame, array_column: str, output: str = "features") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.col(array_column).cast("array<double>")))


def with_class_weight(df: DataFrame, label: str, weight_0: float, weight_1: float = 1.0) -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label) == 0, weight_0).otherwise(weight_1))


def _element(spark: SparkSession, vector: str, index: int, output: str) -> IsotonicRegressionModel:
    """A stage that reads one element, between 0 and 1, of a vector: the curve through (0, 0) and (1, 1)."""
    ends = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "x double, y double")
    curve = IsotonicRegression(featuresCol="x", labelCol="y").fit(ends)
    return curve.setFeaturesCol(vector).setFeatureIndex(index).setPredictionCol(output)


def _without(*columns: str) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(columns)}) FROM __THIS__")


class ModelScorer:
    """A fitted chain of Spark's own stages that adds ``score``; calling it scores rows, saving it keeps all stages."""

    def __init__(self, stages: Sequence[Transformer]):
        self.model = PipelineModel(list(stages))

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def then(self, *stages: Transformer) -> ModelScorer:
        return ModelScorer([*self.model.stages, *stages])

    def with_threshold(self, threshold: float) -> ModelScorer:
        """Adds ``predicted_label`` and ``confidence``: the whole of what is needed to label rows elsewhere."""
        return self.then(SQLTransformer(statement=(
            f"SELECT *, CAST(score >= {threshold!r}D AS INT) AS predicted_label, score AS confidence FROM __THIS__")))

    def save(self, path: str) -> None:
        save_model(self.model, path)

    @staticmethod
    def load(path: str) -> ModelScorer:
        return ModelScorer(forest.load_stages(path))


def pipeline_scorer(model: PipelineModel) -> ModelScorer:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()  # other threads have no active one
    return ModelScorer([
        *model.stages, _element(spark, "probability", 1, "score"), _without("rawPrediction", "probability", "prediction", "scaled"),
    ])


def _scaler() -> StandardScaler:
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)


def _scaled(stage) -> Pipeline:
    """Scaling and classifier in one pipeline, so that a saved model keeps both."""
    return Pipeline(stages=[_scaler(), stage])


def fit_logreg(train: DataFrame, label: str = "label") -> PipelineModel:
    weight = {"weightCol": "weight"} if "weight" in train.columns else {}
    return _scaled(LogisticRegression(
        featuresCol="scaled", labelCol=label, maxIter=1000, regParam=1.0 / max(1, train.count()), **weight)).fit(train)


MAX_DEPTH = 30  # Spark's limit; trees end earlier where a leaf is pure


def fit_forest(train: DataFrame, label: str = "label", trees: int = 100, max_depth: int = MAX_DEPTH,
               seed: int = 42) -> PipelineModel:
    """Trees grown to purity, or to ``max_depth`` levels.

    Rows keep the node that they are in, so a pass over them does not descend all trees again. Trees whose nodes may not
    fit on the driver together are fitted a few at a time, each time with another seed, and kept in the shared folder.
    """
    weight = {"weightCol": "weight"} if "weight" in train.columns else {}

    def some(n: int, before: int) -> RandomForestClassifier:
        return RandomForestClassifier(
            featuresCol="scaled", labelCol=label, numTrees=n, maxDepth=max_depth, seed=seed + 1_000_003 * before, cacheNodeIds=True,
            **weight)

    at_once = forest.trees_at_once(train.count(), trees)
    if at_once >= trees:
        return _scaled(some(trees, 0)).fit(train)
    scaler = _scaler().fit(train)
    scaled = materialise(scaler.transform(train), "scaled")
    parts = forest.fit_parts(train.sparkSession, trees, at_once, lambda n, before: some(n, before).fit(scaled))
    return PipelineModel([scaler, forest.PartedForest(parts, "scaled")])


def fit_boosted(train: DataFrame, label: str = "label", val: DataFrame | None = None,
                rounds: int = 2000, seed: int = 42) -> PipelineModel:
    """Depth 5, rate 0.05, 80 % of rows per tree and features per node; stops early on the loss over ``val``,
    not on its precision-recall area."""
    options = {"weightCol": "weight"} if "weight" in train.columns else {}
    rows = train
    if val is not None:
        columns = [c for c in train.columns if c in val.columns]
        rows = train.select(*columns, F.lit(False).alias("held")).unionByName(
            val.select(*columns, F.lit(True).alias("held")))
        options["validationIndicatorCol"] = "held"
    return _scaled(GBTClassifier(
        featuresCol="scaled", labelCol=label, maxIter=rounds, maxDepth=5, stepSize=0.05, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", seed=seed, **options)).fit(rows)


def fit_perceptron(train: DataFrame, label: str = "label", width: int | None = None, seed: int = 42) -> PipelineModel:
    """Two hidden layers of 64 and 32; this estimator takes no class weights and has no held-out early stop."""
    width = width or len(train.select(vector_to_array("features").alias("f")).head().f)
    return _scaled(MultilayerPerceptronClassifier(
        featuresCol="scaled", labelCol=label, layers=[width, 64, 32, 2], seed=seed)).fit(train)


def fit_linear_svm(train: DataFrame, key: str, label: str = "label", folds: int = 3, seed: int = 42) -> ModelScorer:
    """Linear SVM with sigmoid calibration: margin model and Platt scaling per fold, scores averaged.

    The penalty is C = 1. Each label's rows are dealt to the folds in turn, so no fold lacks one that has enough.
    """
    weight = {"weightCol": "weight"} if "weight" in train.columns else {}
    drawn = train.withColumn("_u", hash_uniform(F.col(key), F.lit("fold"), seed=seed))
    folded = positions(drawn, "_u", [key], by=[label]).withColumn("_fold", F.col("position") % folds).drop("_u", "position", "group_n")
    folded = materialise(folded, "folds")

    def fit(fold: int) -> list[Transformer]:
        fit_rows, held = folded.where(F.col("_fold") != fold), folded.where(F.col("_fold") == fold)
        margins = _scaled(LinearSVC(featuresCol="scaled", labelCol=label, regParam=1.0 / max(1, fit_rows.count()), **weight)).fit(fit_rows)
        own = [*margins.stages, VectorSlicer(inputCol="rawPrediction", outputCol="margin", indices=[1]), _without("rawPrediction", "prediction", "scaled")]
        platt = LogisticRegression(featuresCol="margin", labelCol=label).fit(
            PipelineModel(own).transform(held.select(label, "features")).select(label, "margin"))
        return [
            *own, platt, _element(train.sparkSession, "probability", 1, f"_p{fold}"),
            _without("margin", "rawPrediction", "probability", "prediction"),
        ]

    fitted = side_by_side(train.sparkSession, [lambda fold=fold: fit(fold) for fold in range(folds)])
    stages = [stage for own in fitted for stage in own]
    members = [f"_p{fold}" for fold in range(folds)]
    mean = SQLTransformer(statement=f"SELECT *, ({' + '.join(members)}) / {folds} AS score FROM __THIS__")
    return ModelScorer([*stages, mean, _without(*members)])


def fit_isotonic(scored: DataFrame, label: str = "label", score: str = "score") -> ModelScorer:
    """Monotone calibration of scores, clipped at the ends of the fitted range.

    Adjacent violators are pooled on the executors; what reaches the driver are the blocks of the result. Their means
    rise strictly, and with labels 0 and 1 the means are fractions whose denominators add up to no more than the n
    rows, so there are at most about 0.9 n^(2/3) of them.
    """
    blocks = pooled_blocks(scored, label, score)
    ends = blocks.select(F.explode(F.array("low", "high")).alias("x"), F.col("fit").alias("y")).distinct()
    curve = IsotonicRegression(featuresCol="x", labelCol="y").fit(ends)
    return ModelScorer([
        curve.setFeaturesCol(score).setPredictionCol("_fit"), _without(score),
        SQLTransformer(statement=f"SELECT * EXCEPT (_fit), _fit AS {score} FROM __THIS__"),
    ])


def compare_models(train: DataFrame, val: DataFrame, test: DataFrame, key: str, label: str = "label",
                   names: Sequence[str] = ("logreg", "forest", "boosted", "svm", "mlp"),
                   boosting_rounds: int = 2000, forest_trees: int = 100,
                   reference_threshold: bool = False) -> tuple[DataFrame, dict[str, ModelScorer]]:
    """Fit, tune the threshold, calibrate and test each model: (metrics table, scorers).

    The threshold is tuned in the score space it is used in. With
    ``reference_threshold`` it is tuned on raw validation scores and applied to
    calibrated test scores. The models are fitted at the same time, so ``train_seconds``
    is what a fit took beside the others.
    """
    fits = {
        "logreg": lambda: pipeline_scorer(fit_logreg(train, label)),
        "forest": lambda: pipeline_scorer(fit_forest(train, label, forest_trees)),
        "boosted": lambda: pipeline_scorer(fit_boosted(train, label, val, boosting_rounds)),
        "svm": lambda: fit_linear_svm(train, key, label),
        "mlp": lambda: pipeline_scorer(fit_perceptron(train, label)),
    }
    spark = train.sparkSession

    def compare(name: str) -> tuple[dict, ModelScorer]:
        start = time.time()
        raw = fits[name]()
        seconds = time.time() - start
        val_raw = raw(val).select(label, "score").persist()
        if name == "svm":
            scorer, val_final = raw, val_raw
        else:
            calibrate = fit_isotonic(val_raw, label)
            scorer = raw.then(*calibrate.model.stages)
            val_final = calibrate(val_raw)
        tuned_on = val_raw if reference_threshold else val_final
        threshold = metrics.cost_threshold(tuned_on, label, "score").head()["threshold"]
        test_scored = scorer(test).select(label, "score").persist()
        row = {"model": name, "threshold": threshold, "train_seconds": seconds}
        for part, scored in (("val", tuned_on), ("test", test_scored)):
            labelled = scored.withColumn("pred", (F.col("score") >= threshold).cast("int"))
            row[f"{part}_roc_auc"] = metrics.roc_auc(scored, label, "score").head()[0]
            row[f"{part}_pr_auc"] = metrics.average_precision(scored, label, "score").head()[0]
            report = {r["row"]: r for r in metrics.class_report(labelled, label, "pred").collect()}
            for short, line in (("f1_0", "0"), ("f1_1", "1"), ("f1_macro", "macro avg"), ("f1_micro", "micro avg")):
                row[f"{part}_{short}"] = report[line]["f1"] if line in report else 0.0
        row["test_cost_accuracy"] = metrics.cost_accuracy(
            test_scored.withColumn("pred", (F.col("score") >= threshold).cast("int")), label, "pred").head()[0]
        val_raw.unpersist()
        test_scored.unpersist()
        return row, scorer

    compared = side_by_side(spark, [lambda name=name: compare(name) for name in names])
    rows, scorers = [row for row, _ in compared], {row["model"]: scorer for row, scorer in compared}
    fields = list(rows[0])
    schema = ", ".join(f"{f} {'string' if f == 'model' else 'double'}" for f in fields)
    return spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], schema), scorers


def best_model(table: DataFrame) -> DataFrame:
    """Row of the model with the largest validation ROC-AUC."""
    return table.agg(F.max_by(F.struct(*table.columns), F.struct("val_roc_auc", "model")).alias("b")).select("b.*")


def score_all(scorer: Scorer, rows: DataFrame, key: str, threshold: float, exclude: DataFrame | None = None) -> DataFrame:
    """(key, predicted_label, confidence) of every row not in ``exclude``."""
    todo = rows if exclude is None else rows.join(exclude.select(key), key, "left_anti")
    return scorer(todo).select(
        key, (F.col("score") >= threshold).cast("int").alias("predicted_label"), F.col("score").alias("confidence"))


def save_model(model: PipelineModel, path: str) -> None:
    forest.save_stages(model, path)


def load_scorer(path: str) -> ModelScorer:
    """The scorer of a saved classifier that has no score of its own yet."""
    return pipeline_scorer(PipelineModel(forest.load_stages(path)))


def independent_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns left after dropping constant ones and those that earlier ones determine.

    Works on the correlation matrix, whose size depends on the columns only.
    """
    return [columns[i] for i in _independent(_correlations(df, columns))]


def _independent(matrix: np.ndarray) -> list[int]:
    """Rows of a correlation matrix that earlier ones do not determine: one Cholesky pass that leaves out the others."""
    kept: list[int] = []
    lower = np.zeros((0, 0))
    for i in range(len(matrix)):
        across = matrix[i, kept]
        if not np.isfinite(matrix[i, i]) or not np.isfinite(across).all():
            continue
        row = np.linalg.solve(lower, across) if kept else across
        left = matrix[i, i] - row @ row
        if left > 1e-9:
            lower = np.block([[lower, np.zeros((len(kept), 1))], [row[None, :], np.sqrt([[left]])]])
            kept.append(i)
    return kept


def _correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    return Correlation.corr(assemble(df, columns), "features").head()[0].toArray()


def fit_ols(df: DataFrame, features: Sequence[str], target: str):
    """Ordinary least squares with intercept by the normal equations.

    ``features`` must be linearly independent, see ``independent_columns``.
    """
    rows = assemble(df.withColumn("_y", F.col(target).cast("double")).dropna(subset=["_y"]), features)
    return LinearRegression(featuresCol="features", labelCol="_y", solver="normal", standardization=False).fit(rows)


def ols_summary(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """(term, coef, std_err, t, p_value, r2, adj_r2) per term, intercept as 'const'."""
    s = model.summary
    values = [*model.coefficients, model.intercept]
    rows = [
        (term, float(values[i]), float(s.coefficientStandardErrors[i]), float(s.tValues[i]), float(s.pValues[i]),
         float(s.r2), float(s.r2adj))
        for i, term in enumerate([*features, "const"])
    ]
    return spark.createDataFrame(
        rows, "term string, coef double, std_err double, t double, p_value double, r2 double, adj_r2 double")


def ols_residuals(df: DataFrame, model, features: Sequence[str], target: str) -> DataFrame:
    """Adds ``fitted`` and ``residual`` as plain column arithmetic."""
    fitted = F.lit(float(model.intercept))
    for feature, coef in zip(features, model.coefficients):
        fitted = fitted + F.col(feature) * float(coef)
    return df.withColumn("fitted", fitted).withColumn("residual", F.col(target) - F.col("fitted"))


def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation factors: diagonal of the inverse correlation matrix.

    The matrix is features x features, whatever the number of rows. A constant column and
    those that determine one another get NULL; the others are measured against all.
    """
    matrix = _correlations(df, features)
    kept = _independent(matrix)
    # A constant column correlates with nothing, itself aside.
    varied = [i for i in range(len(features)) if np.isfinite(np.delete(matrix[i], i)).any() or len(features) == 1]
    values, vectors = np.linalg.eigh(matrix[np.ix_(varied, varied)])
    # Columns with a part in a vanishing combination depend on one another.
    null = vectors[:, values < 1e-9]
    dependent = {varied[i] for i in np.flatnonzero((np.abs(null) > 1e-6).any(axis=1))}
    inverse = np.linalg.inv(matrix[np.ix_(kept, kept)])
    found = {i: float(inverse[k, k]) for k, i in enumerate(kept) if i not in dependent}
    rows = [(f, found.get(i)) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")
