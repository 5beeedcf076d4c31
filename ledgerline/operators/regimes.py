"""Regime filters as grouped Arrow work: one task per series, kernels in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.kernels import Params


def _schema(returns: DataFrame, key: str, order: str, columns: list[str]) -> str:
    kinds = dict(returns.dtypes)
    return ", ".join([f"{key} {kinds[key]}", f"{order} {kinds[order]}", "r double", *[f"{c} double" for c in columns]])


def hamilton_filter(returns: DataFrame, params: Params, covariate: str | None = None, smoother: bool = False, key: str = "asset", order: str = "fecha", r: str = "r") -> DataFrame:
    """Per key and time: predicted (xi_p_k) and filtered (xi_f_k) probabilities, variances s2_k, and loglik.

    ``covariate`` names a column already lagged by the feature layer; it is not lagged again. With
    ``smoother`` the smoothed probabilities come too, named diag_smooth_k, for diagnosis only.
    """
    k = len(params.mu)
    names = [f"{p}_{i}" for p in ("xi_p", "xi_f", "s2") for i in range(k)] + ["loglik"] + ([f"diag_smooth_{i}" for i in range(k)] if smoother else [])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order).reset_index(drop=True)
        out = kernels.run_filter(part[r].to_numpy(float), params, part[covariate].to_numpy(float) if covariate else None)
        blocks = [out["predicted"], out["filtered"], out["s2"], out["ll"][:, None]]
        if smoother:
            blocks.append(kernels.smooth(out["filtered"], out["predicted"], params.arrays()["P"]))
        frame = pd.DataFrame(np.concatenate(blocks, 1), columns=names)
        return pd.concat([part[[key, order]], part[r].rename("r"), frame], axis=1)

    return returns.select(key, order, r, *([covariate] if covariate else [])).groupBy(key).applyInPandas(run, _schema(returns, key, order, names))


def with_regime(filtered: DataFrame, k: int = 2) -> DataFrame:
    """Adds entropy, entropy_norm (by ln K; 0 for one regime) and argmax_idx of the filtered probabilities."""
    from ..functions.cleaning import entropy, first_argmax

    xs = F.array(*[F.col(f"xi_f_{i}") for i in range(k)])
    return filtered.withColumns({"entropy": entropy(xs), "entropy_norm": entropy(xs) / float(np.log(k)) if k > 1 else F.lit(0.0), "argmax_idx": first_argmax(xs)})


def garchx(returns: DataFrame, driver: str, theta: dict[str, float], key: str = "asset", order: str = "fecha", r: str = "r") -> DataFrame:
    """Variance s2 and normal log likelihood of a GARCH with a lagged driver column."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order).reset_index(drop=True)
        x = part[r].to_numpy(float)
        s2 = kernels.garchx_variances(x, part[driver].to_numpy(float), **theta)
        ll = -0.5 * (kernels.LOG_2PI + np.log(s2) + (x - theta["mu"]) ** 2 / s2)
        return pd.concat([part[[key, order]], part[r].rename("r"), pd.DataFrame({"s2": s2, "loglik": ll})], axis=1)

    return returns.select(key, order, r, driver).groupBy(key).applyInPandas(run, _schema(returns, key, order, ["s2", "loglik"]))
