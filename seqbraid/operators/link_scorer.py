"""A logistic scorer of oriented node pairs, reported by contig and closure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqbraid.operators.features import pair_features
from seqbraid.operators.metrics import ranking_metrics
from seqbraid.operators.models import Standardizer, fit_logistic, optimality, predict
from seqbraid.operators.ordering import with_position
from seqbraid.operators.skew import attach
from seqbraid.session import materialise

GROUP = ["target_sn", "closure"]


@dataclass(frozen=True)
class LinkScores:
    """A fit on the train pairs; what is not asked for is not computed.

    `predictions` of the test pairs, metrics `by_group` and `overall`, and the fit's `certificate`.
    """

    table: DataFrame
    names: DataFrame
    scaler: Standardizer
    model: Model
    kept: Sequence[str]

    @property
    def train(self) -> DataFrame:
        return self.scaler.transform(self.table.filter("split = 'train'"))

    @cached_property
    def predictions(self) -> DataFrame:
        scored = predict(self.model, self.scaler.transform(self.table.filter("split = 'test'")))
        named = attach(scored, self.names, ["_name"], "inner")
        return materialise(named.select(*self.kept, F.col("probability")[1].alias("p")))

    @cached_property
    def by_group(self) -> DataFrame:
        return ranking_metrics(self.predictions, GROUP).withColumnRenamed("n", "n_edges")

    @cached_property
    def overall(self) -> DataFrame:
        return ranking_metrics(self.predictions).withColumnRenamed("n", "n_edges")

    @cached_property
    def certificate(self) -> DataFrame:
        return optimality(self.model, self.train, balanced=False)


def score_links(
    pairs: DataFrame, metadata: DataFrame, degrees: DataFrame, features: Sequence[str]
) -> LinkScores:
    """Fit on the train pairs and score the test pairs.

    `pairs` has (target_sn, closure, u, v, y, split) and may have more columns; pairs of the
    val split are used for neither and get no features. Every pair weighs the same. Columns are
    standardised on the train pairs. The ranking metrics of a group with one label are null.
    Names of slices and groups are put back on the predictions.
    """
    kept = [c for c in pairs.columns if c != "split"]
    texts = [c for c in kept if c in ("slice_id", *GROUP)]
    named = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in texts]
    used = pairs.filter("split <> 'val'")
    names = with_position(used.select(*texts).distinct(), texts, name="_name")
    names = materialise(names.withColumn("_name", F.col("_name").cast("int")))
    coded = used.join(names.toDF(*[f"_{c}" for c in texts], "_name"), reduce(and_, named))
    rest = [c for c in pairs.columns if c not in texts]
    table = pair_features(coded.select("_name", *rest), metadata, degrees)
    table = materialise(table.na.fill(0, list(features)))
    scaler = Standardizer(table.filter("split = 'train'"), list(features))
    model = fit_logistic(scaler.transform(table.filter("split = 'train'")), balanced=False)
    return LinkScores(table, names, scaler, model, kept)
