"""Resampling tests on contingency tables: respondents are counted by Spark first, so a group is a few cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallywright.functions.stats import chi2_sf, fisher, t_two_sided


def table(cells: pd.DataFrame) -> np.ndarray:
    return cells.pivot_table(index="x", columns="y", values="k", aggfunc="sum", fill_value=0).to_numpy(dtype="int64")


def rhos(tables: np.ndarray) -> np.ndarray:
    """Spearman's rho with midranks of each table of (draw, x, y) counts; not a number if a margin is constant."""
    rows, cols = tables.sum(2), tables.sum(1)
    mid = (rows.sum(1, keepdims=True) + 1) / 2
    x, y = np.cumsum(rows, 1) - (rows - 1) / 2 - mid, np.cumsum(cols, 1) - (cols - 1) / 2 - mid
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.einsum("mij,mi,mj->m", tables, x, y) / np.sqrt((rows * x**2).sum(1) * (cols * y**2).sum(1))


def rank_tests(cells: DataFrame, draws: int = 1999, permutations: int = 9999, exact_below: int = 500, seed: int = 0) -> DataFrame:
    """(grp, n, rho, lo, hi, p) of each group's cells (grp, x, y, k).

    lo and hi are the percentile interval of a bootstrap of the cells; p is of random permutations up to exact_below
    respondents, and of the t approximation beyond. All are null if a margin is constant.
    """

    def one(cells: pd.DataFrame) -> pd.DataFrame:
        t, rng = table(cells), np.random.default_rng(seed)
        n, rho = int(t.sum()), float(rhos(t[None])[0])
        if np.isnan(rho):
            return pd.DataFrame({"grp": [cells["grp"].iloc[0]], "n": [n], "rho": [None], "lo": [None], "hi": [None], "p": [None]})
        boot = rhos(rng.multinomial(n, (t / n).ravel(), size=draws).reshape(draws, *t.shape))
        lo, hi = np.nanpercentile(boot, [2.5, 97.5])
        if n <= exact_below:
            i, j = (np.repeat(a, t.ravel()) for a in np.divmod(np.arange(t.size), t.shape[1]))
            x, y = pd.Series(i).rank().to_numpy(), pd.Series(j).rank().to_numpy()
            x, y = x - x.mean(), y - y.mean()
            found = rng.permuted(np.tile(y, (permutations, 1)), axis=1) @ x / np.sqrt((x @ x) * (y @ y))
            p = (np.count_nonzero(np.abs(found) >= abs(rho) - 1e-12) + 1) / (permutations + 1)
        else:
            p = t_two_sided(rho * np.sqrt((n - 2) / max(1e-300, 1 - rho * rho)), n - 2)
        return pd.DataFrame({"grp": [cells["grp"].iloc[0]], "n": [n], "rho": [rho], "lo": [lo], "hi": [hi], "p": [p]})

    return cells.groupBy("grp").applyInPandas(one, "grp string, n long, rho double, lo double, hi double, p double")


def random_tables(rows: np.ndarray, cols: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Random (draw, x, y) tables with these margins: cell by cell, each hypergeometric given those before it, all draws at once."""
    left, out = np.tile(cols, (draws, 1)), np.zeros((draws, len(rows), len(cols)), dtype="int64")
    for i, r in enumerate(rows[:-1]):
        need = np.full(draws, r)
        for j in range(len(cols) - 1):
            out[:, i, j] = rng.hypergeometric(left[:, j], left[:, j + 1 :].sum(1), need)
            need = need - out[:, i, j]
        out[:, i, -1] = need
        left = left - out[:, i]
    out[:, -1] = left
    return out


def independence_tests(cells: DataFrame, draws: int = 9999, seed: int = 0) -> DataFrame:
    """(grp, n, chi2, p, method) of each group's cells (grp, x, y, k); null if a margin is constant.

    p is the chi-square tail if every expected cell is five or more, Fisher's exact one of other 2x2 tables, and else of random
    tables with the same margins. Sparse tables of a billion respondents or more, which numpy can't draw, take the tail too.
    """

    def one(cells: pd.DataFrame) -> pd.DataFrame:
        t, rng = table(cells), np.random.default_rng(seed)
        n, rows, cols = int(t.sum()), t.sum(1), t.sum(0)
        own, p, method = None, None, "undefined"
        if min(t.shape) >= 2:
            expected = np.outer(rows, cols) / n
            own = float(((t - expected) ** 2 / expected).sum())
            if expected.min() >= 5 or n >= 10**9:
                p, method = chi2_sf(own, (len(rows) - 1) * (len(cols) - 1)), "chi2"
            elif t.shape == (2, 2):
                p, method = fisher(*map(int, t.ravel())), "fisher"
            else:
                drawn = ((random_tables(rows, cols, draws, rng) - expected) ** 2 / expected).sum((1, 2))
                p, method = (int(np.count_nonzero(drawn >= own - 1e-9)) + 1) / (draws + 1), "random"
        return pd.DataFrame({"grp": [cells["grp"].iloc[0]], "n": [n], "chi2": [own], "p": [p], "method": [method]})

    return cells.groupBy("grp").applyInPandas(one, "grp string, n long, chi2 double, p double, method string")
