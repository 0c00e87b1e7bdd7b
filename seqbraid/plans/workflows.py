"""Whole studies composed from the operators: label, build features, split, fit, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbraid.operators.features import feature_table, structural_features
from seqbraid.operators.labels import label_counts, label_set
from seqbraid.operators.metrics import (
    best_threshold,
    binary_report,
    class_report,
    confusion_matrix,
    macro_f1,
)
from seqbraid.operators.models import (
    Standardizer,
    fit_classifier,
    mean_embeddings,
    optimality,
    predict,
    spread_embedding,
)
from seqbraid.operators.sampling import downsample
from seqbraid.operators.skew import attach
from seqbraid.operators.splits import chrom_split, covered_segments
from seqbraid.session import materialise


def _require_trainable(table: DataFrame, labels: int) -> None:
    per_split = {
        r["split"]: r
        for r in table.groupBy("split").agg(F.countDistinct("y").alias("k"), F.count("*").alias("n")).collect()
    }
    if "train" not in per_split or per_split["train"]["k"] < labels:
        few = "two labels" if labels > 1 else "one label"
        raise RuntimeError(f"the train split has fewer than {few} after filtering")
    if "test" not in per_split:
        raise RuntimeError("the test split is empty after filtering")


def fit_and_report(
    table: DataFrame,
    features: Sequence[str],
    names: list[str],
    method: str,
    seed: int = 42,
    present_only: bool = False,
    one_label: bool = False,
    **options: int,
) -> dict[str, DataFrame]:
    """Fit on the train rows of `table` (segid, chrom, y, split, features) and report.

    Returns predictions of the val and test rows, label counts, per-class,
    per-chromosome and overall metrics, the confusion matrix, and for two
    classes the thresholded report. Metrics are taken over the test rows. A two-class
    logistic fit also has `certificate`, the gradient at its weights.

    Train rows of a single label are an error. With `one_label` they are fitted: every row is
    given that label, which is the limit of the fit, as where elements cover all segments.
    """
    table = materialise(table)
    _require_trainable(table, 1 if one_label else 2)
    train_rows = table.filter("split = 'train'")
    scaler = Standardizer(train_rows, list(features))
    scaled = scaler.transform(train_rows)
    model = fit_classifier(method, scaled, len(features), len(names), "y", seed, **options)
    scored = materialise(
        predict(model, scaler.transform(table.filter("split <> 'train'"))).withColumn(
            "p", F.col("probability")[1]
        )
    )
    test, val = scored.filter("split = 'test'"), scored.filter("split = 'val'")
    report = class_report(test, names)
    by_chrom = class_report(test, names, ["chrom"])
    out = {
        "predictions": scored.select("segid", "chrom", "split", "y", "pred", "p"),
        "label_counts": label_counts(train_rows, names).withColumn("split", F.lit("train")).unionByName(
            label_counts(test, names).withColumn("split", F.lit("test"))
        ),
        "per_class": report,
        "overall": macro_f1(report, (), present_only),
        "per_chrom": macro_f1(by_chrom, ["chrom"], present_only),
        "confusion": confusion_matrix(test, len(names)),
    }
    if len(names) == 2:
        if method == "logistic":
            out["certificate"] = optimality(model, scaled)
        limit = best_threshold(val).first()["threshold"]
        out["binary"] = (
            binary_report(test, limit)
            .withColumn("split", F.lit("test"))
            .unionByName(binary_report(val, limit).withColumn("split", F.lit("val")))
        )
    return out


def aligned_baseline(
    labels: DataFrame,
    index: DataFrame,
    links: DataFrame,
    val: Sequence[str],
    test: Sequence[str],
    method: str = "logistic",
    feature_set: str = "structural",
    scheme: str = "group4",
    positive_group: str | None = None,
    background_only: bool = True,
    universe: tuple[DataFrame, DataFrame] | None = None,
    closures: Sequence[str] = ("strict", "1hop"),
    seed: int = 42,
    one_label: bool = False,
    **options: int,
) -> dict[str, DataFrame]:
    """Node classification on one of the feature sets.

    `universe` is (slice_segments, manifest) to evaluate only nodes that occur in
    benchmark windows; the context features see exactly the remaining rows.
    """
    rows, names = label_set(labels, scheme, positive_group, background_only)
    if universe is not None:
        inside = covered_segments(universe[0], universe[1], labels, closures)
        rows = attach(rows, inside, ["segid"], "left_semi")
    rows = materialise(rows.select("segid", "chrom", "SO", "LN", "y"))
    table, features = feature_table(rows, index, links, feature_set)
    table = table.withColumn("split", chrom_split(F.col("chrom"), val, test))
    return fit_and_report(table, features, names, method, seed, one_label=one_label, **options)


def embedding_baseline(
    labels: DataFrame,
    vectors: DataFrame,
    width: int,
    val: Sequence[str],
    test: Sequence[str],
    method: str = "logistic",
    scheme: str = "group4",
    positive_group: str | None = None,
    background_only: bool = True,
    seed: int = 42,
    **options: int,
) -> dict[str, DataFrame]:
    """Node classification on mean embeddings; `vectors` has oid and an array `x`."""
    rows, names = label_set(labels, scheme, positive_group, background_only)
    means = mean_embeddings(vectors)
    joined = materialise(rows.select("segid", "chrom", "y").join(means, "segid"))
    table, features = spread_embedding(joined.drop("n"), "embedding", width)
    table = table.withColumn("split", chrom_split(F.col("chrom"), val, test))
    out = fit_and_report(table, features, names, method, seed, **options)
    out["coverage"] = joined.agg(
        F.count("*").alias("n_embedded"), F.avg("n").alias("mean_occurrences")
    )
    return out


def structural_baseline(
    labels: DataFrame,
    index: DataFrame,
    links: DataFrame,
    val: Sequence[str],
    test: Sequence[str],
    binary: bool = True,
    negative_fraction: float = 1.0,
    drop_reference: bool = True,
    seed: int = 42,
    one_label: bool = False,
    **options: int,
) -> dict[str, DataFrame]:
    """Balanced logistic regression on structural features, binary or nine classes.

    Background rows of the train split can be thinned; evaluation rows never are.
    """
    rows, names = label_set(labels, "binary" if binary else "full9")
    table = structural_features(rows.select("segid", "chrom", "y"), index, links, drop_reference)
    features = [c for c in table.columns if c not in ("segid", "chrom", "y")]
    table = materialise(table.withColumn("split", chrom_split(F.col("chrom"), val, test)))
    thin = (F.col("split") == "train") & (F.col("y") == 0)
    table = downsample(table, thin, negative_fraction, "segid", seed)
    return fit_and_report(
        table, features, names, "logistic", seed, present_only=True, one_label=one_label, **options
    )
