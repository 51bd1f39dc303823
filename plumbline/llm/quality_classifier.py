"""Quality classifier: regularised quadratic discriminant on document statistics.

The statistics are native expressions; each is squashed by a log or logit-like transform. Class
means and covariances come from sums over all labelled training rows (no sample), each covariance
is shrunk towards the pooled one and its diagonal, and its Cholesky factor is kept. A score is the
logistic of the difference of the two log densities, from Mahalanobis distances and determinants.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, id_hash, table, whole_row
from .textstats import with_stats

FEATURES = 12


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``x``, the transformed statistics of the whole text."""
    df = with_stats(docs, text).drop("st_words")
    n, w, li = (F.greatest(F.col(c).cast("double"), F.lit(1.0)) for c in ("st_n_chars", "st_n_words", "st_n_lines"))
    ratio = lambda c, of: F.log(F.lit(1e-3) + F.col(c) / of)
    xs = [
        F.log1p(F.col("st_n_words").cast("double")),
        (n - F.col("st_space")) / w / 10,
        ratio("st_upper", n),
        ratio("st_digit", n),
        ratio("st_symbol", n),
        ratio("st_punct", n),
        ratio("st_stop", w),
        ratio("st_accent", n),
        ratio("st_other", n),
        ratio("st_n_repeat_words", w),
        ratio("st_n_dup_lines", li),
        F.log1p(F.col("st_n_words") / li),
    ]
    assert len(xs) == FEATURES
    return df.withColumn("x", F.array(*(x.cast("double") for x in xs)))


@dataclass(frozen=True)
class Qda:
    """Means, inverse Cholesky factors and log determinants of the two classes."""

    prior: np.ndarray
    mean: np.ndarray
    inv: np.ndarray
    logdet: np.ndarray
    clip: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(np.nan_to_num(x), *self.clip)
        log = [self.prior[k] - self.logdet[k] / 2 - (((x - self.mean[k]) @ self.inv[k].T) ** 2).sum(1) / 2 for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(labelled: DataFrame, *, shrink: float = 0.2, ridge: float = 0.05) -> Qda:
    """Fits on all rows (x, y). Only sums leave the executors: 2 x (1 + d + d * d) numbers in all."""
    d = FEATURES

    def sums(batches):
        acc = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x, y = np.array(b["x"].tolist(), dtype=float).reshape(-1, d), b["y"].to_numpy()
            for k in (0, 1):
                z = x[y == k]
                acc[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pd.DataFrame({"y": np.repeat([0, 1], acc.shape[1]), "i": np.tile(np.arange(acc.shape[1]), 2), "v": acc.ravel()})

    total = np.zeros((2, 1 + d + d * d))
    for r in labelled.select("x", "y").mapInPandas(sums, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        total[r.y, r.i] = r.v
    count = total[:, 0]
    if not count.all():  # one class at most: the score is the share of label 1, even odds without rows
        p = np.log((count + 1e-9) / (count + 1e-9).sum()) if count.sum() else np.log([0.5, 0.5])
        return Qda(p, np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), (np.full(d, -1e9), np.full(d, 1e9)))
    mean = total[:, 1 : 1 + d] / count[:, None]
    second = total[:, 1 + d :].reshape(2, d, d) / count[:, None, None]
    cov = second - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * count[:, None, None]).sum(0) / count.sum()
    scale = np.maximum(np.diag(pooled), 1e-4)
    inv, logdet = np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        s = (1 - shrink) * cov[k] + shrink * pooled
        s = (1 - ridge) * s + ridge * np.diag(scale)
        factor = np.linalg.cholesky(s + 1e-9 * np.eye(d))
        inv[k], logdet[k] = np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()
    spread = 10 * np.sqrt(scale)
    return Qda(np.log(count / count.sum()), mean, inv, logdet, (mean.min(0) - spread, mean.max(0) + spread))


def score(feats: DataFrame, model: Qda) -> DataFrame:
    """Adds ``score`` in 0 to 1, the probability of label 1."""

    @F.pandas_udf("double")
    def probability(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist(), dtype=float).reshape(-1, FEATURES)))

    return feats.withColumn("score", probability("x"))


def train(feats: DataFrame, labels: DataFrame, fold: int = 1, of: int = 3) -> Qda:
    """Fits on labelled rows outside the held-out fold. Labels other than 0 and 1 are left out."""
    y = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y"))
    return fit(feats.where(id_hash() % of != fold).select("doc_id", "x").join(y, "doc_id"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; null and empty texts get a score like any other. Null ids count
    as crc32 0 and are never labelled; repeated rows give a row each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    feats = durable(features(docs).select("doc_id", "x"), "op1")
    out = score(feats, train(feats, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id",
        (id_hash() % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def filter_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents scored 0.5 or more, with their own columns only.

    It learns from the labelled documents among its input; without any, nothing is rejected. Null and empty texts are
    scored like others; rows with a null id are never labelled; repeated rows get one score."""
    wide = docs.select(whole_row(docs).alias("doc"), "text", "doc_id")
    feats = durable(features(wide).select("doc", "doc_id", "x"), "op1-stage")
    return score(feats, train(feats, table(spark, sf_dir, "labels"))).where("score >= 0.5").select("doc.*")
