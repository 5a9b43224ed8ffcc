"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the earlier ones."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that are features beside the words: they stand for all endings and compounds.
STEMS = (5, 6, 7)


def features(text: str) -> set[str]:
    """The words of a text in lower case, and the beginnings of longer words, marked with a star."""
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


def labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, str], most: int, folds: int, id_col: str, text_col: str) -> DataFrame:
    """(key, categories, text, fold): the labelled documents to learn from.

    At most so many of those in docs, those with the least hash of the identifier. Of rows that repeat an identifier the
    least text is taken. Equal texts are in one fold.
    """
    ys = [F.expr(e).cast("int").alias(c) for c, e in categories.items()]
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("key"), *ys).dropna().dropDuplicates(["key"])
    texts = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = materialize(known.join(texts.select("key").hint("merge"), "key", "left_semi").orderBy(F.xxhash64("key"), "key").limit(most), "chosen")
    found = texts.join(F.broadcast(chosen), "key").groupBy("key", *categories).agg(F.min("text").alias("text"))  # at most `most` rows are broadcast
    return found.withColumn("fold", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(folds)).cast("int"))


def vocabularies(sample: DataFrame, categories: list[str], folds: int, least_docs: int, least_chi2: float, most: int) -> list[list[str]]:
    """The features whose presence and a category are most dependent (chi-square), at most so many for each.

    One list for the rows outside each fold, and the last for all rows.
    """
    parts = range(folds)
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]]
    sums += [F.count_if(F.col("fold") == k).alias(f"n_{k}") for k in parts] + [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for k in parts for c in categories]
    all_ = sample.agg(*sums).first()
    if not all_["n"]:
        return [[] for _ in range(folds + 1)]
    counts = materialize(sample.select(F.explode("f").alias("f"), "fold", *categories).groupBy("f").agg(*sums).where(F.col("n") >= least_docs), "features")
    out: list[list[str]] = []
    for k in [*parts, None]:
        less = lambda c, k=k: F.col(c) if k is None else F.col(c) - F.col(f"{c}_{k}")
        n, found = all_["n"] - (0 if k is None else all_[f"n_{k}"]), set()
        for c in categories:
            y = all_[c] - (0 if k is None else all_[f"{c}_{k}"])
            if 0 < y < n:
                gap = less(c) * F.lit(float(n)) - less("n") * F.lit(float(y))
                chi2 = gap * gap / (less("n") * (F.lit(float(n)) - less("n") + 0.5) * F.lit(float(y) * (n - y) / n))
                found |= {r[0] for r in counts.where(less("n") >= least_docs).select("f", chi2.alias("x")).where(F.col("x") >= least_chi2).orderBy(F.desc("x"), "f").limit(most).collect()}
        out.append(sorted(found))
    return out


class Sparse:
    """Rows of present features, as one array of columns and the row of each."""

    def __init__(self, columns: list[np.ndarray], width: int):
        self.col = np.concatenate([*columns, np.zeros(0, "int64")]).astype("int64")
        self.row = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
        self.n, self.width = len(columns), width

    def fit(self, y: np.ndarray, extra: np.ndarray, use: np.ndarray, among: np.ndarray, ridge: float, steps: int) -> np.ndarray:
        """Weights of a ridge logistic regression on features, extra columns and a constant, by accelerated gradient steps.

        use: the rows to learn from; among: the features that may have a weight.
        """
        w = v = np.zeros(self.width + extra.shape[1] + 1)
        mine = use[self.row] & among[self.col]
        col, row = self.col[mine], self.row[mine]
        size = float(np.bincount(row, minlength=self.n).max(initial=0) + extra.shape[1] + 1)
        m = use.astype(float)
        # a step for each weight: the curvature is at most a quarter of the row size times the rows that have the feature
        rate = 1.0 / (0.25 * size * np.concatenate((np.bincount(col, minlength=self.width), (extra**2).T @ m, [max(1.0, m.sum())])) + ridge)
        for k in range(steps):
            p = 1 / (1 + np.exp(-self.score(v, extra, col, row)))
            r = (p - y) * m
            grad = np.concatenate((np.bincount(col, weights=r[row], minlength=self.width), extra.T @ r, [r.sum()]))
            grad[:-1] += ridge * v[:-1]
            new = v - rate * grad
            v = new + k / (k + 3) * (new - w)
            w = new
        return w

    def score(self, w: np.ndarray, extra: np.ndarray, col: np.ndarray | None = None, row: np.ndarray | None = None) -> np.ndarray:
        col, row = (self.col, self.row) if col is None else (col, row)
        return np.bincount(row, weights=w[col], minlength=self.n) + extra @ w[self.width : -1] + w[-1]


def fit_chain(columns: list[np.ndarray], ys: np.ndarray, fold: np.ndarray, among: list[np.ndarray], ridge: float, steps: int) -> list[np.ndarray]:
    """A weight vector for each category in order.

    What a later category sees of the training rows are out-of-fold predictions: those of models whose features were chosen
    and whose weights were fitted without the row's fold. The model kept for scoring is fitted on all rows.
    among: which features each fold's model may use, and last those of the model of all rows.
    """
    x, n = Sparse(columns, len(among[-1])), len(columns)
    extra, chain = np.zeros((n, 0)), []
    for k in range(ys.shape[1]):
        y, out = ys[:, k].astype(float), np.zeros(n)
        for f in np.unique(fold):
            w = x.fit(y, extra, fold != f, among[f], ridge, steps)
            out[fold == f] = (1 / (1 + np.exp(-x.score(w, extra))))[fold == f]
        chain.append(x.fit(y, extra, np.ones(n, dtype=bool), among[-1], ridge, steps))
        extra = np.column_stack((extra, out))
    return chain


#: Categories of the chain, from the label columns. Low quality comes first, as it needs no other category.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic", "toxic_low_quality": "toxic * (1 - quality)"}


def judge(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, reject: tuple[str, ...] = ("toxic", "toxic_low_quality"), id_col: str = "doc_id", text_col: str = "text", most: int = 8_000, folds: int = 3, least_docs: int = 3, least_chi2: float = 10.8, most_features: int = 400, ridge: float = 0.2, steps: int = 250, cut: float = 0.5) -> Callable[[Column], Column]:
    """Fits the chain, and gives a function from a text column to a struct of p_<category> for each category, and rejected.

    rejected: the probability of a category in reject is at least cut. Learning uses at most `most` labelled rows, whatever
    the input: a linear model needs no more for its features, the words of at least least_docs of these rows whose chi-square with a
    category is at least least_chi2 (0.1 % at one degree of freedom, which doesn't depend on the number of rows), the
    strongest most_features for each category. Labels that are null or of no document are left out; without labels of both
    kinds a category has the probability of its share (0 without any). Of rows that repeat an identifier the least text is learnt from.
    """
    spark, categories = docs.sparkSession, categories or CATEGORIES
    names = list(categories)
    reject = tuple(c for c in reject if c in names)
    found = F.pandas_udf(lambda t: t.map(lambda x: sorted(features(x))), "array<string>")
    sample = materialize(labelled(docs, labels, categories, most, folds, id_col, text_col).select("key", "fold", *names, found("text").alias("f")), "labelled")
    lists = vocabularies(sample, names, folds, least_docs, least_chi2, most_features)
    vocab = sorted(set().union(*lists))
    known = F.array_intersect("f", F.array(*map(F.lit, vocab))) if vocab else F.array().cast("array<string>")
    rows = sample.select("key", "fold", *names, known.alias("f")).orderBy("key").toArrow().to_pandas()  # at most `most` rows of chosen features
    place = {f: i for i, f in enumerate(vocab)}
    columns = [np.array(sorted(place[f] for f in fs), dtype="int64") for fs in rows["f"]]
    ys = rows[names].to_numpy(dtype=float).reshape(-1, len(names))
    among = [np.isin(np.arange(len(vocab)), [place[f] for f in fs]) for fs in lists]
    chain = fit_chain(columns, ys, rows["fold"].to_numpy(dtype="int64"), among, ridge, steps) if len(rows) else None
    shared = spark.sparkContext.broadcast((place, chain))

    @F.pandas_udf(", ".join([*[f"p_{c} double" for c in names], "rejected boolean"]))
    def score(texts: pd.Series) -> pd.DataFrame:
        place, chain = shared.value
        columns = [np.array(sorted(place[f] for f in features(t) & place.keys()), dtype="int64") for t in texts]
        x, extra = Sparse(columns, len(place)), np.zeros((len(columns), 0))
        for k in range(len(names)):
            p = 1 / (1 + np.exp(-x.score(chain[k], extra))) if chain else np.zeros(len(columns))
            extra = np.column_stack((extra, p))
        return pd.DataFrame(extra, columns=[f"p_{c}" for c in names]).assign(rejected=(extra[:, [names.index(c) for c in reject]] >= cut).any(axis=1))

    return lambda text: score(F.coalesce(text, F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per input row: doc_id, p_<category> for each category of the chain, rejected; settings are those of judge.

    Scoring reads every whole text, and each row is judged by its own text, so repeated rows and those without an identifier have
    their verdicts too. Null text counts as empty. Other columns are ignored; an empty table gives an empty result.
    """
    verdict = judge(docs, labels, id_col=id_col, text_col=text_col, **settings)
    return docs.select(F.col(id_col).alias("doc_id"), verdict(F.col(text_col)).alias("v")).select("doc_id", "v.*")
