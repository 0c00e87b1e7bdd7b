"""Standardised Spark ML classifiers on feature tables, and a two-axis projection."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbraid.operators.skew import attach


def mean_embeddings(vectors: DataFrame) -> DataFrame:
    """(segid, embedding, n): mean over all slices and both strands.

    `vectors` has oid and an array column `x`. Every task sends one partial vector per
    segment, however often a node is met; null vectors do not count.
    """
    x = array_to_vector("x")
    return (
        vectors.filter("x is not null")
        .groupBy(F.shiftright("oid", 1).alias("segid"))
        .agg(Summarizer.mean(x).alias("_m"), F.count("*").alias("n"))
        .select("segid", vector_to_array("_m").alias("embedding"), "n")
    )


class Standardizer:
    """Zero mean, unit population variance from the train rows; constant columns become 0."""

    def __init__(self, train: DataFrame, columns: list[str]) -> None:
        stats = train.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()  # one row of 2 numbers per feature
        self.columns = columns
        self.moments = [
            (stats[f"m{i}"] or 0.0, stats[f"s{i}"] or 0.0) for i in range(len(columns))
        ]

    def expressions(self) -> list[Column]:
        return [
            ((F.col(c) - F.lit(m)) / F.lit(s) if s > 0 else F.lit(0.0)).alias(c)
            for c, (m, s) in zip(self.columns, self.moments)
        ]

    def transform(self, rows: DataFrame) -> DataFrame:
        keep = [c for c in rows.columns if c not in self.columns]
        scaled = rows.select(*keep, *self.expressions())
        return VectorAssembler(inputCols=self.columns, outputCol="features").transform(scaled)


def spread_embedding(rows: DataFrame, column: str, width: int) -> tuple[DataFrame, list[str]]:
    """An array column as `width` plain feature columns."""
    names = [f"e{i}" for i in range(width)]
    keep = [c for c in rows.columns if c != column]
    return rows.select(*keep, *[F.col(column)[i].alias(n) for i, n in enumerate(names)]), names


def with_balanced_weights(train: DataFrame, label: str = "y") -> tuple[DataFrame, float]:
    """Add `weight` = n / (K * n_class), and return the total weight."""
    counts = train.groupBy(label).agg(F.count("*").alias("_nc"))
    total = counts.agg(F.sum("_nc"), F.count("*")).first()
    n, k = total[0], total[1]
    weighted = attach(train, counts, [label], "inner")
    return weighted.withColumn("weight", F.lit(float(n)) / (F.lit(float(k)) * F.col("_nc"))).drop("_nc"), float(n)


def fit_logistic(
    train: DataFrame,
    label: str = "y",
    balanced: bool = True,
    max_iter: int = 800,
    c: float = 1.0,
    tol: float = 1e-12,
) -> Model:
    """L2 logistic regression on `features`; strength 1/C on the summed, weighted loss.

    The ML library averages the loss, so the strength is divided by the total weight. The
    tolerance is on the change of the loss, which is quadratic in the distance from the
    optimum; `optimality` tells how close a fit came.
    """
    if balanced:
        rows, total = with_balanced_weights(train, label)
    else:
        rows = train.withColumn("weight", F.lit(1.0))
        total = float(train.count())
    return LogisticRegression(
        labelCol=label,
        weightCol="weight",
        regParam=1.0 / (c * total),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    ).fit(rows)


def optimality(
    model: Model, train: DataFrame, label: str = "y", balanced: bool = True, c: float = 1.0
) -> DataFrame:
    """One row that proves a two-class `fit_logistic`: n_train, n_pos, max_gradient.

    The gradient of the penalised mean loss at the fitted weights, taken over all train
    rows as one aggregate with one partial sum per feature and task. The loss is convex
    and, but for the intercept, strictly so: a gradient of 0 is the optimum.
    """
    if balanced:
        rows, total = with_balanced_weights(train, label)
    else:
        rows, total = train.withColumn("weight", F.lit(1.0)), float(train.count())
    weights = [float(w) for w in model.coefficients]
    scored = model.transform(rows).select(
        F.col(label).alias("_y"),
        (F.col("weight") * (vector_to_array("probability")[1] - F.col(label))).alias("_r"),
        vector_to_array("features").alias("_x"),
    )
    slopes = [
        F.sum(F.col("_r") * F.col("_x")[i]) / total + F.lit(w / (c * total))
        for i, w in enumerate(weights)
    ]
    steepest = F.array_max(F.array(*[F.abs(g) for g in [*slopes, F.sum("_r") / total]]))
    return scored.agg(
        F.count("*").alias("n_train"),
        F.count_if(F.col("_y") == 1).alias("n_pos"),
        steepest.alias("max_gradient"),
    )


def fit_mlp(
    train: DataFrame, n_features: int, n_classes: int, label: str = "y", seed: int = 42, max_iter: int = 100
) -> Model:
    """Hidden layers of 128 and 64 units."""
    layers = [n_features, 128, 64, n_classes]
    return MultilayerPerceptronClassifier(
        labelCol=label, layers=layers, seed=seed, maxIter=max_iter, blockSize=512
    ).fit(train)


def fit_forest(
    train: DataFrame,
    label: str = "y",
    seed: int = 42,
    trees: int = 400,
    max_depth: int = 30,
    max_bins: int = 64,
    n_classes: int | None = None,
) -> Model:
    """Balanced random forest with at least two rows per leaf.

    `n_classes` gives every listed class a probability, also one without a train row.

    `max_depth` is the deepest that the ML library grows; `max_bins` are the split
    candidates of a feature.
    """
    rows, _ = with_balanced_weights(train, label)
    if n_classes is not None:
        nominal = {"ml_attr": {"name": label, "type": "nominal", "num_vals": n_classes}}
        rows = rows.withMetadata(label, nominal)
    return RandomForestClassifier(
        labelCol=label, weightCol="weight", numTrees=trees, minInstancesPerNode=2, seed=seed, maxDepth=max_depth, maxBins=max_bins
    ).fit(rows)


def fit_classifier(
    method: str,
    train: DataFrame,
    n_features: int,
    n_classes: int,
    label: str = "y",
    seed: int = 42,
    **options: int,
) -> Model:
    if method == "logistic":
        return fit_logistic(train, label, **options)
    if method == "mlp":
        return fit_mlp(train, n_features, n_classes, label, seed, **options)
    if method == "random_forest":
        return fit_forest(train, label, seed, n_classes=n_classes, **options)
    raise ValueError(f"unknown method {method!r}; choose logistic, mlp or random_forest")


def predict(model: Model, rows: DataFrame) -> DataFrame:
    """Add `pred` and, as an array, the class `probability`."""
    scored = model.transform(rows)
    keep = [c for c in rows.columns if c != "features"]
    return scored.select(
        *keep,
        F.col("prediction").cast("int").alias("pred"),
        vector_to_array("probability").alias("probability"),
    )


def project_two(rows: DataFrame, column: str) -> DataFrame:
    """First two principal axes (pc1, pc2) of a centred array column; signs are arbitrary.

    A projection of uncentred rows differs from that of centred ones by one
    constant vector, so the means are subtracted after the projection.
    """
    vectors = rows.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(vectors)
    flat = model.transform(vectors).withColumn("_a", vector_to_array("_p"))
    means = flat.agg(F.avg(F.col("_a")[0]).alias("_m1"), F.avg(F.col("_a")[1]).alias("_m2"))
    keep = [c for c in rows.columns if c != column]
    return flat.join(F.broadcast(means), how="cross").select(
        *keep,
        (F.col("_a")[0] - F.col("_m1")).alias("pc1"),
        (F.col("_a")[1] - F.col("_m2")).alias("pc2"),
    )
