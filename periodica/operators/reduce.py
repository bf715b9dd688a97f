"""Principal components of the exogenous variables, one decomposition per series.

Spark computes the covariances; only the small symmetric matrix of each series
reaches numpy, a whole Arrow batch of them in one stacked call.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from periodica.operators.align import PanelDataset

#: Up to this many variables all covariances are columns of one aggregation.
WIDE_VARS = 24


def standardize(ds: PanelDataset) -> DataFrame:
    """Realized rows with ``z``: mean 0, population deviation 1, constant columns 0."""
    stats = _center_scale(ds)
    z = F.transform(
        F.arrays_zip("x", "mean", "std"),
        lambda r: F.when(r["std"] > 0, (r["x"] - r["mean"]) / r["std"]).otherwise(F.lit(0.0)),
    )
    return ds.realized.join(stats, "series_id").select("series_id", "period_idx", z.alias("z"))


def _center_scale(ds: PanelDataset) -> DataFrame:
    nv = len(ds.exog_vars)
    col = lambda i: F.get("x", F.lit(i))
    return ds.realized.groupBy("series_id").agg(
        F.array(*[F.avg(col(i)) for i in range(nv)]).alias("mean"),
        F.array(*[F.stddev_pop(col(i)) for i in range(nv)]).alias("std"),
    )


def covariances(ds: PanelDataset) -> DataFrame:
    """``(series_id, n, mean, std, cov)``; ``cov`` is the upper triangle, row by row."""
    nv = len(ds.exog_vars)
    if nv <= WIDE_VARS:
        col = lambda i: F.get("x", F.lit(i))
        pairs = [F.covar_pop(col(i), col(j)) for i in range(nv) for j in range(i, nv)]
        return ds.realized.groupBy("series_id").agg(
            F.count("*").alias("n"),
            F.array(*[F.avg(col(i)) for i in range(nv)]).alias("mean"),
            F.array(*[F.stddev_pop(col(i)) for i in range(nv)]).alias("std"),
            F.array(*pairs).alias("cov"),
        )
    # many variables: variable pairs become rows and are combined map-side
    rows = ds.realized.select("series_id", "x", F.posexplode("x").alias("i", "xi")).select(
        "series_id", "i", "xi", F.posexplode("x").alias("j", "xj")
    ).filter(F.col("i") <= F.col("j"))
    cells = rows.groupBy("series_id", "i", "j").agg(
        F.covar_pop("xi", "xj").alias("c"), F.count("*").alias("n")
    )
    packed = cells.groupBy("series_id").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "j", "c"))).alias("_c")
    )
    return packed.select("series_id", "n", F.col("_c.c").alias("cov")).join(_center_scale(ds), "series_id")


def _eigen(nv: int, explained_variance: float):
    @F.pandas_udf("ratio array<double>, vec array<array<double>>")
    def solve(cov: pd.Series, n: pd.Series) -> pd.DataFrame:
        upper = np.stack(cov.to_numpy()).astype(float)
        i, j = np.triu_indices(nv)
        m = np.zeros((len(upper), nv, nv))
        m[:, i, j] = upper
        m[:, j, i] = upper
        known = np.isfinite(m).all(axis=(1, 2))
        m[~known] = 0.0
        std = np.sqrt(np.maximum(np.diagonal(m, axis1=1, axis2=2), 0.0))
        scale = np.where(std > 0, std, 1.0)
        corr = m / scale[:, :, None] / scale[:, None, :]
        values, vectors = np.linalg.eigh(corr)
        values = np.maximum(values[:, ::-1], 0.0)
        vectors = np.swapaxes(vectors, 1, 2)[:, ::-1]
        total = values.sum(axis=1, keepdims=True)
        ratio = np.divide(values, total, out=np.zeros_like(values), where=total > 0)
        most = np.minimum(n.to_numpy(), nv)
        if explained_variance >= 1.0:
            k = most
        elif explained_variance <= 0.0:
            k = np.zeros_like(most)
        else:
            # smallest count whose cumulative share is strictly above the target
            cum = np.cumsum(ratio, axis=1)
            k = np.minimum((cum <= explained_variance).sum(axis=1) + 1, most)
        return pd.DataFrame(
            {
                "ratio": [ratio[r, : k[r]].tolist() if known[r] else None for r in range(len(k))],
                "vec": [vectors[r, : k[r]].tolist() if known[r] else None for r in range(len(k))],
            }
        )

    return solve.asNondeterministic()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)


def pca_fit(ds: PanelDataset, explained_variance: float = 0.9) -> DataFrame:
    """``(series_id, mean, std, ratio, vec)``, signs fixed.

    A component's sign makes its largest absolute score on the standardized
    realized rows positive (earliest period on ties).
    """
    if not 0.0 <= explained_variance <= 1.0:
        raise ValueError("explained_variance must be between 0 and 1")
    nv = len(ds.exog_vars)
    eig = _eigen(nv, explained_variance)
    raw = covariances(ds).withColumn("_e", eig("cov", "n")).select("series_id", "mean", "std", "_e.ratio", "_e.vec")
    scored = ds.realized.join(raw, "series_id").withColumn("score", F.transform("vec", lambda v: dot(v, _z())))
    signs = []
    for k in range(nv):
        s = F.get("score", F.lit(k))
        top = F.max_by(s, F.struct(F.round(F.abs(s), 9), -F.col("period_idx")))
        signs.append(F.when(top < 0, F.lit(-1.0)).otherwise(F.lit(1.0)))
    same = [F.any_value(c).alias(c) for c in ("mean", "std", "ratio", "vec")]
    signed = scored.groupBy("series_id").agg(*same, F.array(*signs).alias("sign"))
    flipped = F.transform("vec", lambda v, k: F.transform(v, lambda a: a * F.get("sign", k)))
    return signed.select("series_id", "mean", "std", "ratio", flipped.alias("vec"))


def _z() -> Column:
    return F.transform(
        F.arrays_zip("x", "mean", "std"),
        lambda r: F.when(r["std"] > 0, (r["x"] - r["mean"]) / r["std"]).otherwise(F.lit(0.0)),
    )


def pca_loadings(fit: DataFrame, exog_vars: Sequence[str]) -> DataFrame:
    """Long loadings ``(series_id, component, component_name, var, loading)``.

    A component is named after the variable with the largest absolute loading,
    the first one on ties.
    """
    names = F.array(*[F.lit(v) for v in exog_vars]).cast("array<string>")
    comp = fit.select("series_id", F.posexplode("vec").alias("component", "w"))
    rounded = F.transform("w", lambda a: F.round(F.abs(a), 12))
    top = F.array_position(rounded, F.array_max(rounded)).cast("int")
    label = F.concat(
        F.lit("PCA"), F.col("component").cast("string"), F.lit("_correlated_w_"), F.element_at(names, top)
    )
    return comp.select("series_id", "component", label.alias("component_name"), F.posexplode("w").alias("pos", "loading")).select(
        "series_id", "component", "component_name", F.get(names, F.col("pos")).alias("var"), "loading"
    )


def pca_transform(ds: PanelDataset, explained_variance: float = 0.9, standardize_scores: bool = False) -> PanelDataset:
    """Replace the variables by component scores, realized and future rows alike.

    Scores are the raw variables times the loadings; ``standardize_scores`` uses
    standardized variables instead. Series may keep different numbers of components.
    """
    if not ds.exog_vars:
        return ds
    fit = pca_fit(ds, explained_variance)
    source = _z() if standardize_scores else F.col("x")
    scores = F.transform("vec", lambda v: dot(v, source))
    df = ds.df.join(fit, "series_id").select("series_id", "period_idx", "is_future", "y", scores.alias("x"))
    names = () if explained_variance <= 0.0 else tuple(f"PCA{i}" for i in range(len(ds.exog_vars)))
    return replace(ds, df=df, exog_vars=names, ragged=True)
