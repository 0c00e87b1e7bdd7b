"""Per-row loss expressions; average them to get the metric."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def focal_bce(
    p: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25, pos_weight: float | Column = 1.0
) -> Column:
    """Focal binary cross-entropy of a probability; p is clipped to [1e-7, 1-1e-7]."""
    clipped = F.greatest(F.lit(1e-7), F.least(F.lit(1.0 - 1e-7), p))
    positive = y == 1
    p_true = F.when(positive, clipped).otherwise(1.0 - clipped)
    weight = F.when(positive, F.lit(alpha) * pos_weight).otherwise(F.lit(1.0 - alpha))
    return -weight * F.pow(1.0 - p_true, F.lit(gamma)) * F.ln(p_true)


def weighted_logloss(p: Column, y: Column, pos_weight: float | Column) -> Column:
    """Binary cross-entropy with weighted positives; logs are floored at -100."""
    floor = F.lit(-100.0)
    log_hit = F.greatest(floor, F.when(p > 0, F.ln(p)).otherwise(floor))
    log_miss = F.greatest(floor, F.when(p < 1, F.ln(1.0 - p)).otherwise(floor))
    return F.when(y == 1, -log_hit * pos_weight).otherwise(-log_miss)


def multiclass_focal(
    logits: Column,
    target: Column,
    gamma: float = 2.0,
    class_weights: list[float] | None = None,
    label_smoothing: float = 0.0,
) -> Column:
    """Focal loss from an array of logits; null targets give null and drop out of avg()."""
    top = F.array_max(logits)
    log_norm = F.ln(
        F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    ) + top
    log_true = F.element_at(logits, target + 1) - log_norm
    focus = F.pow(F.greatest(F.lit(1e-7), 1.0 - F.exp(log_true)), F.lit(gamma))
    entropy = -log_true
    if label_smoothing > 0:
        mean_logit = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + x) / F.size(logits)
        entropy = (1.0 - label_smoothing) * entropy + label_smoothing * (log_norm - mean_logit)
    if class_weights is None:
        return focus * entropy
    weights = F.array(*[F.lit(float(w)) for w in class_weights])
    return F.element_at(weights, target + 1) * focus * entropy
