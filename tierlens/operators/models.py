"""Penalised logistic risk models with a separate calibration step; scores are columns.

One model is fitted by MLlib, several over the same rows in shared passes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sigmoid
from ..plans.lineage import cut_lineage
from .features import Preprocessor, fit_preprocessor
from .newton import fit_together
from .splits import disjoint_ids

MAX_ITERATIONS = 200


@dataclass(frozen=True)
class LogisticModel:
    l2: float
    intercept: float
    coef: tuple[float, ...]
    n: int
    positives: int
    converged: bool = True
    iterations: int = 0
    constant_probability: float | None = None

    def __post_init__(self):
        if not all(map(math.isfinite, (self.intercept, *self.coef))) or not self.coef:
            raise ValueError("coefficients must be finite and non-empty")
        if self.constant_probability is not None and not 0 < self.constant_probability < 1:
            raise ValueError("constant probability must lie strictly between 0 and 1")

    def logit(self, inputs: Sequence[Column]) -> Column:
        if len(inputs) != len(self.coef):
            raise ValueError("feature count differs from the fitted model")
        if self.constant_probability is not None:
            return F.lit(math.log(self.constant_probability / (1 - self.constant_probability)))
        out = F.lit(self.intercept)
        for weight, x in zip(self.coef, inputs, strict=True):
            out = out + F.lit(weight) * x
        return out

    def probability(self, inputs: Sequence[Column]) -> Column:
        return sigmoid(self.logit(inputs))

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, value: dict) -> LogisticModel:
        return cls(**{**value, "coef": tuple(value["coef"])})


def fit_logistic(df: DataFrame, inputs: Sequence[str], label: str, l2: float = 1.0) -> LogisticModel:
    """Minimise summed log-loss + l2/2 |w|^2 (intercept free).  MLlib averages the loss, hence l2 / n.

    One class only is not fitted: the smoothed class share is returned as a constant.
    """
    if l2 <= 0:
        raise ValueError("l2 must be positive")
    n, positives = df.agg(F.count(label), F.coalesce(F.sum(label), F.lit(0))).first()
    if n == 0:
        raise ValueError("no training rows")
    if positives in (0, n):
        return LogisticModel(l2, 0.0, (0.0,) * len(inputs), n, positives,
                             constant_probability=(positives + 0.5) / (n + 1))
    vectors = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(df).select(
        "features", F.col(label).cast("double").alias("label"))
    fitted = LogisticRegression(
        regParam=l2 / n, elasticNetParam=0.0, standardization=False, tol=1e-12, maxIter=MAX_ITERATIONS,
    ).fit(vectors)
    rounds = fitted.summary.totalIterations
    return LogisticModel(l2, float(fitted.intercept), tuple(float(c) for c in fitted.coefficients), n, positives,
                         converged=rounds < MAX_ITERATIONS, iterations=rounds)


def fit_logistics(df: DataFrame, models: dict[str, tuple[Sequence[str], str, float]]) -> dict[str, LogisticModel]:
    """Models of (input columns, label, l2) fitted in shared passes (see :mod:`newton`); one class gives a constant."""
    out = {}
    for name, fit in zip(models, fit_together(df, list(models.values()))):
        single = fit.positives in (0, fit.n)
        out[name] = LogisticModel(
            fit.l2, 0.0 if single else float(fit.at[0]), tuple(0.0 if single else float(w) for w in fit.at[1:]), fit.n, fit.positives,
            converged=fit.converged, iterations=fit.steps, constant_probability=(fit.positives + 0.5) / (fit.n + 1) if single else None)
    return out


def score_residuals(df: DataFrame, model: LogisticModel, inputs: dict[str, Column], label: str) -> DataFrame:
    """(term, n, residual): the mean gradient of the penalised loss per coefficient, 0 at the optimum."""
    rows = df.where(F.col(label).isNotNull())
    miss = model.probability(list(inputs.values())) - F.col(label)
    # a constant model has no coefficients to test: its residual is that of the smoothed share
    penalty = dict(zip(inputs, model.coef))
    sums = {"intercept": F.sum(miss)} | {n: F.sum(miss * x) + F.lit(model.l2 * penalty[n]) for n, x in inputs.items()}
    found = F.array(*[F.struct(F.lit(n).alias("term"), F.count("*").alias("n"), (s / F.count("*")).alias("residual")) for n, s in sums.items()])
    return rows.agg(found.alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")


@dataclass(frozen=True)
class RiskModel:
    preprocessor: Preprocessor
    model: LogisticModel
    calibrator: LogisticModel | None = None

    def logit(self, source=F.col) -> Column:
        return self.model.logit(self.preprocessor.columns(source))

    def predict(self, source=F.col) -> Column:
        """Risk as one expression over raw feature columns: scoring never leaves the scan stage."""
        logit = self.logit(source)
        return sigmoid(logit) if self.calibrator is None else self.calibrator.probability([logit])

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """Same as :meth:`predict`, with the logit evaluated once per row."""
        final = F.col("_logit") if self.calibrator is None else self.calibrator.logit([F.col("_logit")])
        return (df.withColumn("_logit", self.logit()).withColumn("_final", final)
                .withColumn(out, sigmoid("_final")).drop("_logit", "_final"))

    def to_dict(self) -> dict:
        return {"preprocessor": self.preprocessor.to_dict(), "model": self.model.to_dict(),
                "calibrator": self.calibrator.to_dict() if self.calibrator else None}

    @classmethod
    def from_dict(cls, value: dict) -> RiskModel:
        calibrator = value.get("calibrator")
        return cls(Preprocessor.from_dict(value["preprocessor"]), LogisticModel.from_dict(value["model"]),
                   LogisticModel.from_dict(calibrator) if calibrator else None)


def fit_risk_model(
    train: DataFrame, names, stage: int, label: str, l2: float = 1.0, preprocessor: Preprocessor | None = None,
) -> RiskModel:
    pre = preprocessor or fit_preprocessor(train, names, stage)
    ready = pre.apply(train.where(F.col(label).isNotNull()))
    inputs = [f"z_{n}" for n in pre.names] + [f"missing_{n}" for n in pre.names]
    return RiskModel(pre, fit_logistic(ready, inputs, label, l2))


def fit_risk_models(
    train: DataFrame, calibration: DataFrame, models: dict[str, tuple[Sequence[str], int, str]], prepared: Preprocessor, l2: float = 1.0,
) -> dict[str, RiskModel]:
    """Models of (features, stage, label), fitted together on ``train`` and calibrated together on ``calibration``.

    ``prepared`` is the preprocessor of all their features, fitted on ``train``.
    """
    own = {name: prepared.subset(features, stage) for name, (features, stage, _) in models.items()}
    inputs = lambda p: [f"z_{n}" for n in p.names] + [f"missing_{n}" for n in p.names]
    labels = list(dict.fromkeys(label for *_, label in models.values()))
    ready = cut_lineage(prepared.apply(train).select(*inputs(prepared), *labels))
    fitted = fit_logistics(ready, {name: (inputs(own[name]), label, l2) for name, (_, _, label) in models.items()})
    raw = {name: RiskModel(own[name], fitted[name]) for name in models}
    logits = cut_lineage(calibration.select(*[m.logit().alias(f"logit_{name}") for name, m in raw.items()], *labels))
    calibrators = fit_logistics(logits, {name: ([f"logit_{name}"], label, 1.0) for name, (_, _, label) in models.items()})
    return {name: RiskModel(m.preprocessor, m.model, calibrators[name]) for name, m in raw.items()}


def calibration_audit(spark, models: dict[str, RiskModel]) -> DataFrame:
    """One row per model: sizes, positives, single classes and convergence of its fit and of its calibration."""
    rows = [(name, m.model.n, m.model.positives, m.calibrator.n, m.calibrator.positives, m.model.constant_probability is not None,
             m.calibrator.constant_probability is not None, m.model.converged, m.calibrator.converged) for name, m in models.items()]
    return spark.createDataFrame(rows, (
        "model string, train_n long, train_positive long, calibration_n long, calibration_positive long, training_single_class boolean, "
        "calibration_single_class boolean, optimizer_converged boolean, calibration_optimizer_converged boolean"))


def calibrate(model: RiskModel, calibration: DataFrame, label: str, training: DataFrame | None = None, row_id="id") -> RiskModel:
    """Second logistic on the raw logit, on rows that took no part in training."""
    if training is not None and not disjoint_ids(calibration, training, row_id).isEmpty():
        raise ValueError("calibration rows must not overlap training rows")
    logits = calibration.select(model.logit().alias("_logit"), label)
    return RiskModel(model.preprocessor, model.model, fit_logistic(logits, ["_logit"], label, 1.0))
