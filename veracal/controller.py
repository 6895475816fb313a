"""One object for a model and a policy: score, decide, evaluate, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scores
from .operators import evaluation
from .plans.model import Model

ESTIMATORS = ("centroid", "lower")


@dataclass(frozen=True)
class SelectionPolicy:
    """What to do with a row, by the alpha that an estimator assigns it."""

    minimum_alpha: float = 0.95
    estimator: str = "centroid"
    accepted_action: str = "allow"
    rejected_action: str = "review"

    def __post_init__(self):
        if self.estimator not in ESTIMATORS or not 0.5 < self.minimum_alpha < 1:
            raise ValueError("unknown estimator, or an alpha outside (0.5, 1)")
        if not self.accepted_action or not self.rejected_action:
            raise ValueError("actions need names")

    def decide(self, scored: DataFrame, ood_limit: int = scores.OOD_LIMIT) -> DataFrame:
        """``scored`` with ``decision``."""
        q = "q_prime" if self.estimator == "centroid" else "q_prime_lower"
        d = scores.decision(F.col(f"{self.estimator}_alpha"), F.col(q if q in scored.columns else "q_prime"), self.minimum_alpha, self.accepted_action, self.rejected_action, ood_limit)
        return scored.withColumn("decision", d)


@dataclass
class Controller:
    model: Model
    policy: SelectionPolicy = SelectionPolicy()

    @classmethod
    def load(cls, spark: SparkSession, path: str, policy: SelectionPolicy | None = None, verify: bool = True) -> Controller:
        from .sources.artifact import load_artifact

        return cls(load_artifact(spark, path, verify), policy or SelectionPolicy())

    def score(self, rows: DataFrame, **options) -> DataFrame:
        return self.model.score(rows, **options)

    def decide(self, scored: DataFrame) -> DataFrame:
        return self.policy.decide(scored, self.model.ood_limit)

    def evaluate(self, scored: DataFrame) -> dict:
        """Totals, conditional cells and minima of all rows, and of those admitted at each alpha of the ladder."""
        c, alphas = self.model.classes, [r[0] for r in self.model.regions]
        scored = scored.persist()
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a few rows by class and alpha
        cells = evaluation.cells(scored, c)
        out = {"totals": rows(evaluation.totals(scored, c))[0], "cells": rows(cells), "minima": rows(evaluation.conditional_minima(cells)), "rejected": rows(evaluation.rejected(scored, c))}
        out["cumulative"] = rows(evaluation.cumulative(scored, c, alphas).orderBy("estimator", F.desc("alpha"))) if alphas else []
        admitted = {}
        for e in ESTIMATORS:
            for a in alphas:
                inside = scored.where(F.col(f"{e}_alpha") >= a)
                admitted[f"{e}@{a}"] = rows(evaluation.cells(inside, c))
        return out | {"admitted": admitted}

    def summarize(self, scored: DataFrame, bins: int = 10) -> dict:
        """Quantiles and histograms of the signals, and prediction frequencies."""
        long = evaluation.signals(scored).persist()
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  signals and bins
        return {
            "quantiles": rows(evaluation.quantiles(long).orderBy("signal")),
            "histograms": rows(evaluation.histogram(long, bins).orderBy("signal", "bin")),
            "predictions": rows(evaluation.prediction_frequencies(scored, self.model.classes).orderBy("prediction")),
        }

    def information(self) -> dict:
        from .sources.artifact import inspect

        return inspect(self.model)
