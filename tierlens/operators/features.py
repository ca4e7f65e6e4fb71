"""Train-only preprocessing and representation distance; fitted state is a few numbers per feature."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage
from ..records import STAGE_1_FEATURES, check_feature_names
from .selection import exact_column_quantiles


def feature_column(name: str) -> Column:
    """A registered feature read from the map of its stage; absent and unknown are both NULL."""
    source = "mlip_features" if name in STAGE_1_FEATURES else "dft_features"
    return F.try_element_at(source, F.lit(name)).alias(name)


@dataclass(frozen=True)
class Preprocessor:
    names: tuple[str, ...]
    stage: int
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    all_missing: tuple[bool, ...]

    def __post_init__(self):
        check_feature_names(self.names, self.stage)
        for part in (self.medians, self.means, self.scales, self.all_missing):
            if len(part) != len(self.names):
                raise ValueError("one parameter per feature is required")
        if not all(map(math.isfinite, (*self.medians, *self.means, *self.scales))) or min(self.scales) <= 0:
            raise ValueError("parameters must be finite and scales positive")

    def columns(self, source=F.col) -> list[Column]:
        """z-scores of all features, then their missing indicators."""
        zs, flags = [], []
        for name, median, mean, scale, gone in zip(
            self.names, self.medians, self.means, self.scales, self.all_missing, strict=True
        ):
            if gone:
                zs.append(F.lit(0.0))
                flags.append(F.lit(1.0))
                continue
            value = source(name)
            zs.append((F.coalesce(value, F.lit(median)) - F.lit(mean)) / F.lit(scale))
            flags.append(value.isNull().cast("double"))
        return zs + flags

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` plus ``z_<name>`` and ``missing_<name>`` columns."""
        labels = [f"z_{n}" for n in self.names] + [f"missing_{n}" for n in self.names]
        return df.withColumns(dict(zip(labels, self.columns(), strict=True)))

    def subset(self, names, stage: int) -> Preprocessor:
        """The same parameters for some of the features."""
        at = [self.names.index(n) for n in names]
        pick = lambda values: tuple(values[i] for i in at)
        return Preprocessor(tuple(names), stage, *map(pick, (self.medians, self.means, self.scales, self.all_missing)))

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, value: dict) -> Preprocessor:
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})


def preprocessor_table(train: DataFrame, names) -> DataFrame:
    """(feature, rows, known, median, mean, scale, all_missing) from the training rows, medians exact.

    Medians of all features come from shared passes over the rows as they are (:mod:`selection`); means and deviations of
    the filled values are one more aggregation.  Without rows the table is empty.
    """
    names = list(dict.fromkeys(names))
    narrow = cut_lineage(train.select(*[F.col(n).cast("double").alias(n) for n in names]))
    medians = exact_column_quantiles(narrow, names)
    sums = []
    for k, n in enumerate(names):
        filled = F.coalesce(F.col(n), F.lit(medians[n][1]), F.lit(0.0))
        sums += [F.avg(filled).alias(f"mean_{k}"), F.stddev_pop(filled).alias(f"scale_{k}")]
    found = narrow.agg(F.count(F.lit(1)).alias("rows"), *sums).first()
    rows = [(n, found["rows"], medians[n][0], medians[n][1] or 0.0, found[f"mean_{k}"], found[f"scale_{k}"]) for k, n in enumerate(names)]
    table = train.sparkSession.createDataFrame(
        rows if found["rows"] else [], "feature string, rows long, known long, median double, mean double, scale double")
    return table.withColumn("scale", F.when(F.col("scale") < 1e-12, 1.0).otherwise(F.col("scale"))).withColumn("all_missing", F.col("known") == 0)


def fit_preprocessor(train: DataFrame, names, stage: int) -> Preprocessor:
    names = list(names)
    check_feature_names(names, stage)
    found = {r["feature"]: r for r in preprocessor_table(train, names).collect()}  # one row per feature
    if not found:
        raise ValueError("no training rows")
    rows = [found[n] for n in names]
    return Preprocessor(
        tuple(names), stage, *[tuple(r[c] for r in rows) for c in ("median", "mean", "scale", "all_missing")]
    )


# ---- Mahalanobis distance ----------------------------------------------------

@dataclass(frozen=True)
class DistanceModel:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    covariance: tuple[tuple[float, ...], ...]
    regularization: float

    @property
    def precision(self) -> np.ndarray:
        c = np.asarray(self.covariance)
        return np.linalg.inv(c + self.regularization * np.eye(len(c)))


def fit_distance(df: DataFrame, vector: str, regularization: float = 0.1) -> DistanceModel:
    """Means, population scales and the covariance of z-scores: two tree aggregations of d x d state."""
    if regularization <= 0:
        raise ValueError("regularization must be positive")
    vectors = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    n, mean, variance = vectors.select(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("_v")).alias("s")
    ).select("s.count", "s.mean", "s.variance").first()
    if n < 2:
        raise ValueError("at least two training vectors are needed")
    scale = np.sqrt(np.maximum(variance.toArray(), 0.0) * (n - 1) / n)
    flat = scale < 1e-12
    corr = Correlation.corr(vectors, "_v").head()[0].toArray()
    corr[flat, :] = corr[:, flat] = 0.0
    corr[np.diag_indices_from(corr)] = np.where(flat, 0.0, 1.0)
    scale[flat] = 1.0
    cov = corr * (n / (n - 1))
    return DistanceModel(tuple(mean.toArray().tolist()), tuple(scale.tolist()), tuple(map(tuple, cov.tolist())), regularization)


def distance_scores(df: DataFrame, vector: str, model: DistanceModel, out: str = "ood_distance") -> DataFrame:
    """Distance per row as one matrix product per Arrow batch; a wrong dimension raises."""
    mean, scale, precision = np.asarray(model.mean), np.asarray(model.scale), model.precision

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        z = (np.stack(batch.to_list()).astype(float) - mean) / scale
        return pd.Series(np.sqrt(np.maximum(np.sum((z @ precision) * z, axis=1), 0.0)))

    checked = F.when(F.size(vector) == len(mean), F.col(vector)).otherwise(
        F.raise_error(F.lit("vector dimension differs from the fitted model")))
    return df.withColumn(out, score(checked))


def covariance_table(df: DataFrame, model: DistanceModel) -> DataFrame:
    """The fitted covariance as (i, j, covariance) rows, d x d of them."""
    d = len(model.mean)
    flat = F.lit([float(v) for row in model.covariance for v in row])
    return df.sparkSession.range(d * d).select(
        F.expr(f"cast(id div {d} as int)").alias("i"), F.expr(f"cast(id % {d} as int)").alias("j"),
        F.element_at(flat, F.col("id").cast("int") + 1).alias("covariance"))
