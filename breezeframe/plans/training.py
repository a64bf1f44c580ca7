"""Regression models on Spark ML: fitting, tuning, scoring and importance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import gcd, sqrt
from random import Random

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.shared import cut_lineage, materialise
from ..operators.dedupe import concat_frames
from ..operators.scores import overfit_gap, rank_models, regression_scores

# --- Fixed values: grids and hyper-parameters -------------------------------
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 500.0)
MAX_TREE_DEPTH = 30
DEPTHS = (3, 5, 7, 10, 15, 20, MAX_TREE_DEPTH)
TREE = {"minInstancesPerNode": 5}
FOREST = {"numTrees": 300, "maxMemoryInMB": 1024, "maxDepth": 15, "minInstancesPerNode": 3, "featureSubsetStrategy": "sqrt"}
BOOSTING = {
    "maxIter": 400,
    "stepSize": 0.05,
    "maxDepth": 5,
    "minInstancesPerNode": 10,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "sqrt",
}
HISTOGRAM = {
    "maxIter": 500,
    "stepSize": 0.05,
    "maxDepth": 6,
    "minInstancesPerNode": 20,
    "maxBins": 255,
}
PATIENCE, HELD_SHARE = 30, 10
PERSISTENCE_LAGS = (1, 7)
SEED = 42
PERMUTATIONS = 30
LABEL = "aqi"


def complete_rows(df: DataFrame, features: Sequence[str], label: str = LABEL) -> DataFrame:
    return df.dropna(subset=[*features, label])


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="raw_features")


def linear_model(train: DataFrame, features: Sequence[str], label: str = LABEL) -> PipelineModel:
    """Least squares on standardised features."""
    stages = [
        _assembler(features),
        StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol="features"),
        LinearRegression(solver="normal", labelCol=label),
    ]
    return Pipeline(stages=stages).fit(train)


@dataclass(frozen=True)
class Moments:
    rows: int
    deviation: float


def label_moments(train: DataFrame, label: str = LABEL) -> Moments:
    r = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("sd")).first()
    return Moments(r["n"], r["sd"])


def _penalised(
    train: DataFrame, features: Sequence[str], label: str, reg: float, mix: float, m: Moments
) -> PipelineModel:
    # Spark scales by the sample deviation; the constant turns that into the population deviation.
    widen = Vectors.dense([sqrt(m.rows / (m.rows - 1))] * len(features))
    stages = [
        _assembler(features),
        StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol="scaled"),
        ElementwiseProduct(scalingVec=widen, inputCol="scaled", outputCol="features"),
        LinearRegression(
            labelCol=label, regParam=reg, elasticNetParam=mix, standardization=False, maxIter=1000, tol=1e-9
        ),
    ]
    return Pipeline(stages=stages).fit(train)


def ridge_model(
    train: DataFrame, features: Sequence[str], alpha: float, label: str = LABEL, m: Moments | None = None
) -> PipelineModel:
    """Penalty ``alpha * |w|^2`` against the residual sum of squares."""
    m = m or label_moments(train, label)
    return _penalised(train, features, label, alpha * m.deviation / m.rows, 0.0, m)


def elastic_model(
    train: DataFrame,
    features: Sequence[str],
    alpha: float,
    l1_ratio: float,
    label: str = LABEL,
    m: Moments | None = None,
) -> PipelineModel:
    """Half mean squared error plus ``alpha * (l1_ratio |w| + (1 - l1_ratio)/2 |w|^2)``.

    Spark divides its quadratic penalty, but not its absolute one, by the label's deviation.
    """
    m = m or label_moments(train, label)
    absolute, quadratic = alpha * l1_ratio, alpha * (1.0 - l1_ratio) * m.deviation
    reg = absolute + quadratic
    return _penalised(train, features, label, reg, absolute / reg if reg else 0.0, m)


def lasso_model(train: DataFrame, features: Sequence[str], alpha: float, label: str = LABEL) -> PipelineModel:
    return elastic_model(train, features, alpha, 1.0, label)


def _trees(features: Sequence[str], regressor) -> Pipeline:
    return Pipeline(stages=[_assembler(features), regressor])


def tree_model(train: DataFrame, features: Sequence[str], depth: int, label: str = LABEL) -> PipelineModel:
    reg = DecisionTreeRegressor(
        featuresCol="raw_features", labelCol=label, maxDepth=depth, seed=SEED, **TREE
    )
    return _trees(features, reg).fit(train)


def forest_model(train: DataFrame, features: Sequence[str], label: str = LABEL, **over) -> PipelineModel:
    reg = RandomForestRegressor(
        featuresCol="raw_features", labelCol=label, seed=SEED, **{**FOREST, **over}
    )
    return _trees(features, reg).fit(train)


def boosting_model(train: DataFrame, features: Sequence[str], label: str = LABEL, **over) -> PipelineModel:
    reg = GBTRegressor(
        featuresCol="raw_features", labelCol=label, seed=SEED, **{**BOOSTING, **over}
    )
    return _trees(features, reg).fit(train)


@dataclass(frozen=True)
class StoppedBoosting:
    """An ensemble cut at its best round: ``curve[k]`` is the held-out mean squared error of the first ``k + 1`` trees."""

    model: PipelineModel
    rounds: int
    curve: list[float]


def held_out(key: Sequence[str] = ("station", "date"), share: int = HELD_SHARE) -> Column:
    """Marks one row in ``share`` by its key, so that reruns agree."""
    return F.pmod(F.xxhash64(*key), F.lit(share)) == 0


def best_round(curve: Sequence[float], patience: int) -> tuple[int, bool]:
    """Number of trees before ``patience`` rounds without a lower error, and whether that many followed."""
    best = 0
    for k, error in enumerate(curve):
        if error < curve[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTRegressionModel, count: int) -> GBTRegressionModel:
    """The ensemble of the first ``count`` trees."""
    jvm, gateway = model._java_obj, SparkContext._active_spark_context._gateway
    trees = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, count)
    weights = gateway.new_array(gateway.jvm.double, count)
    for k in range(count):
        trees[k], weights[k] = jvm.trees()[k], jvm.treeWeights()[k]
    cut = gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(jvm.uid(), trees, weights, jvm.numFeatures())
    return model._copyValues(GBTRegressionModel(jvm.copyValues(cut, jvm.extractParamMap())))


def stopped_boosting(
    train: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    patience: int = PATIENCE,
    first: int = 64,
    key: Sequence[str] = ("station", "date"),
    held: Column | None = None,
    **over,
) -> StoppedBoosting:
    """Boosting that stops after ``patience`` rounds without gain on the ``held`` rows, a tenth by a hash of ``key`` unless
    given, and keeps the best round's trees.

    A round depends on the rounds before it only, so a fit of ``first`` rounds is the beginning of a longer one: the
    number of rounds is doubled until the curve has turned, up to ``maxIter``. Every prefix is scored in one pass.

    Spark ML has no L2 leaf penalty. With a penalty of 1 and at least 20 rows in a leaf every leaf's step would be
    smaller by at most one part in 21; the held-out curve then turns later by about that share.
    """
    settings = {**HISTOGRAM, **over}
    most = settings.pop("maxIter")
    marked = _assembler(features).transform(train.withColumn("_held", held_out(key) if held is None else held))
    learn, kept_out = (cut_lineage(marked.where(c).select("raw_features", F.col(label).cast("double").alias(label))) for c in ("not coalesce(_held, false)", "_held"))
    rounds = min(first, most)
    while True:
        reg = GBTRegressor(featuresCol="raw_features", labelCol=label, seed=SEED, maxIter=rounds, **settings)
        model = reg.fit(learn)
        curve = model.evaluateEachIteration(kept_out, "squared")
        count, turned = best_round(curve, patience)
        if turned or rounds == most:
            return StoppedBoosting(PipelineModel([_assembler(features), first_trees(model, count)]), count, curve)
        rounds = min(2 * rounds, most)


def histogram_model(train: DataFrame, features: Sequence[str], label: str = LABEL, **over) -> PipelineModel:
    """The model of ``stopped_boosting``."""
    return stopped_boosting(train, features, label, **over).model


def rmse_of(model: PipelineModel, df: DataFrame, label: str = LABEL) -> float:
    err = F.col(label) - F.col("prediction")
    return model.transform(df).agg(F.sqrt(F.avg(err * err)).alias("r")).first()["r"]


def tune_ridge(
    train: DataFrame, val: DataFrame, features: Sequence[str], alphas: Sequence[float] = ALPHAS
) -> tuple[float, PipelineModel, list[tuple[float, float]]]:
    """The penalty with the lowest validation RMSE; only the scores reach the driver."""
    m = label_moments(train)
    fitted = [(a, ridge_model(train, features, a, m=m)) for a in alphas]
    trace = [(a, rmse_of(model, val)) for a, model in fitted]
    best = min(range(len(trace)), key=lambda i: trace[i][1])
    return fitted[best][0], fitted[best][1], trace


def tune_tree(
    train: DataFrame, val: DataFrame, features: Sequence[str], depths: Sequence[int] = DEPTHS
) -> tuple[int, PipelineModel, list[tuple[int, float]]]:
    fitted = [(d, tree_model(train, features, d)) for d in depths]
    trace = [(d, rmse_of(model, val)) for d, model in fitted]
    best = min(range(len(trace)), key=lambda i: trace[i][1])
    return fitted[best][0], fitted[best][1], trace


def score(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """Predictions of several models in long form."""
    parts = [
        m.transform(df).select(F.lit(name).alias("model"), "split", "station", "date", LABEL, "prediction")
        for name, m in models.items()
    ]
    return concat_frames(parts)


def persistence(df: DataFrame, lags: Sequence[int] = PERSISTENCE_LAGS) -> DataFrame:
    """The reading of some rows ago as a prediction, in the form of ``score``."""
    parts = [
        df.select(F.lit(f"persistence_{k}").alias("model"), "split", "station", "date", LABEL, F.col(f"lag_{LABEL}_{k}").cast("double").alias("prediction"))
        for k in lags
    ]
    return concat_frames(parts)


def evaluate(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked scores per model, split and station, and the overfit gap per model."""
    scores = regression_scores(predictions)
    return rank_models(scores), overfit_gap(scores)


def importance(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Feature importance normalised to 100 percent (one row per feature)."""
    values = model.stages[-1].featureImportances.toArray()
    total = float(values.sum()) or 1.0
    rows = [(f, float(v) * 100.0 / total) for f, v in zip(features, values, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def coefficients(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, model.stages[-1].coefficients, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def permutation_importance(
    model: PipelineModel,
    df: DataFrame,
    features: Sequence[str],
    label: str = LABEL,
    repeats: int = PERMUTATIONS,
    seed: int = SEED,
) -> DataFrame:
    """Mean and deviation of the R2 lost when one feature is exchanged between rows.

    Rows are numbered in hash order, which is a random order that any executor can recompute. Each
    repeat uses its own bijection ``position -> (a * position + b) mod n`` for all features: a row meets one donor
    a repeat in an equality join, and its features are exchanged one at a time inside the task.
    """
    rows = complete_rows(df, features, label).select("station", "date", *features, label)
    base = _hash_numbered(rows, seed).withColumn("_x", F.array(*[F.col(f).cast("double") for f in features]))
    numbered = base.select("_pos", "_x", F.col(label).alias("_y"))
    totals = numbered.agg(F.count(F.lit(1)).alias("n"), F.var_pop("_y").alias("v")).first()
    n, sst = totals["n"], (totals["n"] * totals["v"] if totals["n"] else 0.0)
    rng = Random(seed)
    plans = []
    for r in range(repeats):
        a = rng.randrange(1, max(2, n))
        while gcd(a, n) != 1 and n:
            a = rng.randrange(1, max(2, n))
        plans.append(F.struct(F.lit(r).alias("r"), F.lit(a).cast("bigint").alias("a"), F.lit(rng.randrange(max(1, n))).cast("bigint").alias("b")))
    wanted = numbered.withColumn("_p", F.explode(F.array(*plans))).select(
        F.col("_p.r").alias("r"),
        "_x",
        "_y",
        # Products stay below 2^63 as decimals, whatever the row count.
        F.expr(
            "CAST((CAST(_p.a AS DECIMAL(19,0)) * CAST(_pos AS DECIMAL(19,0)) + _p.b)"
            f" % CAST({max(1, n)} AS DECIMAL(19,0)) AS BIGINT)"
        ).alias("_partner"),
    )
    donors = numbered.select(F.col("_pos").alias("_partner"), F.col("_x").alias("_other"))
    met = wanted.join(donors, "_partner").withColumn("j", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    swapped = F.transform("_x", lambda v, i: F.when(i == F.col("j"), F.get("_other", F.col("j"))).otherwise(v))
    permuted = met.select("j", "r", "_y", array_to_vector(swapped).alias("raw_features"))
    error = (F.col("_y") - F.col("prediction")) * (F.col("_y") - F.col("prediction"))
    # Feature -1 is the row as it is; its error is the same in every repeat.
    lost = materialise(_transform_features(model, permuted).groupBy("j", "r").agg(F.sum(error).alias("sse")), "permuted-errors")
    plain = lost.where("j = -1").select("r", F.col("sse").alias("_base"))
    names = F.array(*[F.lit(f) for f in features])
    drops = lost.where("j >= 0").join(plain, "r").select(
        F.get(names, F.col("j")).alias("feature"), ((F.col("sse") - F.col("_base")) / F.nullif(F.lit(sst), F.lit(0.0))).alias("drop")
    )
    return drops.groupBy("feature").agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")
    )


#: Rows of a bucket of the hash order, on average.
BUCKET_ROWS = 20_000


def _hash_numbered(rows: DataFrame, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Positions 0..n-1 in hash order: numbered inside hash buckets, offset by the buckets before.

    The number of buckets follows the row count, and their offsets are summed in two levels of about its square root.
    """
    hashed = rows.withColumn("_h", F.xxhash64("station", "date", F.lit(seed)))
    side = 1
    n = rows.count()
    while side * side * bucket_rows < n:
        side *= 2
    bits = 2 * (side.bit_length() - 1)
    bucketed = hashed.withColumn("_b", F.shiftrightunsigned(F.shiftrightunsigned("_h", 1), 63 - bits))
    sizes = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_g", F.shiftright("_b", bits // 2))
    groups = sizes.groupBy("_g").agg(F.sum("_c").alias("_c"))
    before = lambda by, *part: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each of `side` groups of buckets.
    groups = groups.select("_g", F.coalesce(F.sum("_c").over(before("_g", F.lit(0))), F.lit(0)).alias("_o"))
    offsets = sizes.join(groups, "_g").select("_b", (F.col("_o") + F.coalesce(F.sum("_c").over(before("_b", "_g")), F.lit(0))).alias("_o"))
    offsets = materialise(offsets, "hash-offsets")
    inside = Window.partitionBy("_b").orderBy(F.col("_h") < 0, "_h", "station", "date")  # as unsigned numbers, like the buckets
    placed = bucketed.withColumn("_i", F.row_number().over(inside)).join(offsets, "_b")
    return placed.withColumn("_pos", F.col("_o") + F.col("_i") - 1).drop("_h", "_b", "_i", "_o")


def _transform_features(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Run every stage after the assembler on ready-made vectors."""
    return PipelineModel(stages=model.stages[1:]).transform(df)


def predict_vectors(model: PipelineModel, df: DataFrame, values: str) -> DataFrame:
    """Add ``prediction`` for an array column of feature values."""
    scored = _transform_features(model, df.withColumn("raw_features", array_to_vector(values)))
    return scored.drop("raw_features", "scaled", "features")
