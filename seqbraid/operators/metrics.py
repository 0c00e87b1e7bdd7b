"""Exact grouped ranking and classification metrics.

Scores are first reduced to one row per distinct score, which folds any pile of
equal scores, and are then ranked by range-wise running sums, so that one group
with most of the rows is not sorted in one task. Undefined values are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqbraid.functions.losses import focal_bce, weighted_logloss
from seqbraid.operators.labels import names_table
from seqbraid.operators.ordering import running_sums
from seqbraid.operators.skew import attach


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def score_ladder(
    rows: DataFrame, group: Sequence[str] = (), label: str = "y", score: str = "p"
) -> DataFrame:
    """One row per (group, score), best score first, with running `tp` and `seen`."""
    steps = rows.groupBy(*group, F.col(score).alias("score")).agg(
        F.count("*").alias("n"),
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("sq"),
    )
    sums = {"tp": F.col("pos"), "seen": F.col("n")}
    return running_sums(steps, [F.desc("score")], list(group), sums)


def ranking_metrics(
    rows: DataFrame, group: Sequence[str] = (), label: str = "y", score: str = "p"
) -> DataFrame:
    """n, pos_frac, brier, auroc and auprc per group; the last two null for one class.

    AUROC counts a tie as half a win. AUPRC is the sum of recall steps times
    precision over distinct scores.
    """
    ladder = score_ladder(rows, group, label, score)
    neg = F.col("n") - F.col("pos")
    wins = F.sum(neg.cast("double") * (F.col("tp") - F.col("pos") + F.col("pos") / 2))
    n, pos = F.sum("n"), F.sum("pos")
    both = (pos > 0) & (pos < n)
    return ladder.groupBy(*group).agg(
        n.alias("n"),
        (pos / n).alias("pos_frac"),
        (F.sum("sq") / n).alias("brier"),
        F.when(both, wins / (pos.cast("double") * (n - pos))).alias("auroc"),
        F.when(both, F.sum(F.col("pos") * (F.col("tp") / F.col("seen"))) / pos).alias("auprc"),
    )


def best_threshold(
    rows: DataFrame, group: Sequence[str] = (), label: str = "y", score: str = "p"
) -> DataFrame:
    """Score with the highest F1 of `p >= score`, the lowest on ties; 0.5 for one class."""
    group = list(group)
    ladder = score_ladder(rows, group, label, score)
    totals = ladder.groupBy(*group).agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    wide = attach(ladder, totals, group, "inner") if group else ladder.join(F.broadcast(totals), how="cross")
    f1 = 2.0 * F.col("tp") / (F.col("seen") + F.col("_pos"))
    best = F.max_by(F.col("score"), F.struct(f1, -F.col("score")))
    both = (F.max("_pos") > 0) & (F.max("_pos") < F.max("_n"))
    found = wide.groupBy(*group).agg(F.when(both, best).otherwise(0.5).alias("threshold"))
    if group:
        return found
    return found.select(F.coalesce("threshold", F.lit(0.5)).alias("threshold"))


def binary_report(
    rows: DataFrame,
    threshold: float | Column,
    group: Sequence[str] = (),
    label: str = "y",
    score: str = "p",
) -> DataFrame:
    """Thresholded metrics per group next to the ranking metrics.

    Macro-F1 averages the classes that occur in labels or predictions; balanced
    accuracy averages the recall of the classes that occur in labels.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, truth = F.col(score) >= limit, F.col(label) == 1
    counts = rows.groupBy(*group).agg(
        F.count_if(hit & truth).alias("tp"),
        F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & truth).alias("fn"),
        F.count_if(~hit & ~truth).alias("tn"),
        F.max(limit).alias("threshold"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1_one, f1_zero = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    has_one, has_zero = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    in_one, in_zero = (tp + fn > 0).cast("int"), (tn + fp > 0).cast("int")
    report = counts.select(
        *group,
        "threshold",
        _ratio(f1_one * has_one + f1_zero * has_zero, has_one + has_zero).alias("macro_f1"),
        _ratio(recall * in_one + specificity * in_zero, in_one + in_zero).alias("balanced_accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        recall.alias("recall"),
    )
    ranking = ranking_metrics(rows, group, label, score).withColumnRenamed(
        "pos_frac", "positive_fraction"
    )
    return report.join(ranking, list(group)) if group else report.join(ranking, how="cross")


def confusion_counts(
    rows: DataFrame, group: Sequence[str] = (), label: str = "y", pred: str = "pred"
) -> DataFrame:
    """(group, y, pred, n): everything the class metrics need, at most K*K rows a group."""
    return rows.groupBy(
        *group, F.col(label).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")
    ).agg(F.count("*").alias("n"))


def confusion_matrix(rows: DataFrame, n_classes: int, label: str = "y", pred: str = "pred") -> DataFrame:
    """K rows of true classes by K columns pred_0.., zeros filled."""
    ids = rows.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("y"))
    wide = confusion_counts(rows, (), label, pred).groupBy("y").pivot("pred", list(range(n_classes))).sum("n")
    return ids.join(wide, "y", "left").select(
        "y", *[F.coalesce(str(i), F.lit(0)).alias(f"pred_{i}") for i in range(n_classes)]
    )


def class_report(
    rows: DataFrame, names: list[str], group: Sequence[str] = (), label: str = "y", pred: str = "pred"
) -> DataFrame:
    """Precision, recall, F1 and support per group and listed class, zeros for absent ones."""
    group = list(group)
    counts = confusion_counts(rows, group, label, pred)
    # Each count adds to the support of its true class and the predictions of its predicted one.
    sides = F.explode(
        F.array(
            F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
            F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
        )
    )
    hit = F.when((F.col("y") == F.col("pred")) & (F.col("s.support") > 0), F.col("n")).otherwise(0)
    per_class = (
        counts.select(*group, "y", "pred", "n", sides.alias("s"))
        .groupBy(*group, F.col("s.c").alias("y"))
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.predicted").alias("predicted"),
            F.sum(hit).alias("tp"),
        )
    )
    frame = names_table(rows.sparkSession, names)
    if group:
        frame = counts.select(*group).distinct().join(F.broadcast(frame), how="cross")  # K rows per group
    c = {k: F.coalesce(k, F.lit(0)) for k in ("support", "predicted", "tp")}
    return frame.join(per_class, [*group, "y"], "left").select(
        *group,
        "y",
        "class_name",
        _ratio(c["tp"], c["predicted"]).alias("precision"),
        _ratio(c["tp"], c["support"]).alias("recall"),
        _ratio(2 * c["tp"], c["predicted"] + c["support"]).alias("f1"),
        c["support"].alias("support"),
        (c["predicted"] + c["support"] > 0).alias("present"),
    )


def macro_f1(report: DataFrame, group: Sequence[str] = (), present_only: bool = False) -> DataFrame:
    """Macro and support-weighted F1 from a class report.

    `present_only` averages the classes that occur, otherwise all listed ones.
    """
    value = F.when(F.col("present"), F.col("f1")) if present_only else F.col("f1")
    return report.groupBy(*group).agg(
        F.sum("support").alias("n"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def slice_auc(rows: DataFrame, group: Sequence[str] = ("slice_id",), min_rows: int = 4) -> DataFrame:
    """AUROC per slice with at least `min_rows` rows; 0.5 where only one class occurs."""
    return (
        ranking_metrics(rows, group)
        .filter(F.col("n") >= min_rows)
        .select(*group, "n", F.coalesce("auroc", F.lit(0.5)).alias("auc"))
    )


def mean_slice_auc(per_slice: DataFrame) -> DataFrame:
    """Unweighted mean over slices, 0.5 when there are none."""
    return per_slice.agg(
        F.count("*").alias("n_slices"), F.coalesce(F.avg("auc"), F.lit(0.5)).alias("mean_auc")
    )


def target_rollup(per_slice: DataFrame) -> DataFrame:
    """Slices, edges and mean metrics per contig and closure; null metrics are skipped."""
    return per_slice.groupBy("target_sn", "closure").agg(
        F.count("*").alias("n_slices"),
        F.sum("n").alias("n_edges"),
        F.avg("auroc").alias("mean_auroc"),
        F.avg("auprc").alias("mean_auprc"),
        F.avg("brier").alias("mean_brier"),
    )


def link_evaluation(rows: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per slice, pooled, per target) metrics of scored edges (slice_id, y, p)."""
    per_slice = attach(
        ranking_metrics(rows, ["slice_id"]),
        manifest.select("slice_id", "target_sn", "closure"),
        ["slice_id"],
        "inner",
    )
    return per_slice, ranking_metrics(rows), target_rollup(per_slice)


def group_means(rows: DataFrame, group: Sequence[str], metric: str) -> DataFrame:
    """Mean of a per-slice metric, for example per chromosome and split."""
    return rows.groupBy(*group).agg(F.count("*").alias("n_slices"), F.avg(metric).alias(f"mean_{metric}"))


def split_summary(rows: DataFrame) -> DataFrame:
    """Mean AUC per split and closure with the number of slices above chance."""
    return rows.groupBy("split", "closure").agg(
        F.avg("auc").alias("mean_auc"),
        F.count_if(F.col("auc") > 0.5).alias("n_above_half"),
        F.count("*").alias("n_slices"),
    )


def node_evaluation(
    rows: DataFrame, names: list[str], min_labeled: int = 4, binary: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(per slice, pooled) macro-F1 of labelled nodes (slice_id, y, pred[, p]).

    Classes without a label or prediction are left out of a slice's mean. The
    binary task adds balanced accuracy, AUROC and AUPRC from the score `p`.
    """
    labelled = rows.filter(F.col("y").isNotNull())
    enough = labelled.groupBy("slice_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_labeled)
    used = attach(labelled, enough.select("slice_id"), ["slice_id"], "left_semi")
    per_slice = macro_f1(class_report(used, names, ["slice_id"]), ["slice_id"], present_only=True)
    pooled = macro_f1(class_report(used, names), (), present_only=True)
    if binary:
        extra = ["balanced_accuracy", "auroc", "auprc"]
        per_slice = per_slice.join(
            binary_report(used, 0.5, ["slice_id"]).select("slice_id", *extra), "slice_id"
        )
        pooled = pooled.join(binary_report(used, 0.5).select(*extra), how="cross")
    return per_slice, pooled


def loss_summary(
    rows: DataFrame, group: Sequence[str] = (), gamma: float = 2.0, alpha: float = 0.25
) -> DataFrame:
    """Mean focal and weighted log-loss; positives weigh n_neg / max(n_pos, 1)."""
    group = list(group)
    y = F.col("y")
    totals = rows.groupBy(*group).agg(
        (F.count_if(y == 0) / F.greatest(F.count_if(y == 1), F.lit(1))).alias("pos_weight")
    )
    wide = attach(rows, totals, group, "inner") if group else rows.join(F.broadcast(totals), how="cross")
    return wide.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.max("pos_weight").alias("pos_weight"),
        F.avg(focal_bce(F.col("p"), y, gamma, alpha, F.col("pos_weight"))).alias("focal_loss"),
        F.avg(weighted_logloss(F.col("p"), y, F.col("pos_weight"))).alias("weighted_logloss"),
    )
