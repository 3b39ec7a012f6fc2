"""Toxicity by a classifier chain: a linear model for each category, which also sees the categories before it.

In training, a later model gets the probabilities that earlier models gave to texts they had not seen (out of
fold), so it learns how far to trust them. In scoring it gets those of the earlier models fitted on all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import column, packed, unpacked
from parchment.llm.linear import Features, Ftrl, WithMore, margins, sigmoid
from parchment.llm.quality import labelled_sample

#: Whole words and how words begin, whatever their case: abuse shows in either.
FEATURES = Features(signs=False, fold=True, pairs=False, prefixes=(3, 4, 5, 6, 7, 8, 9))


@dataclass(frozen=True)
class ToxicityChain:
    """weights has for each category a vector: hashed features, the earlier categories in order, and a bias."""

    categories: list[str]
    weights: list[np.ndarray]
    thresholds: dict[str, float]
    features: Features = FEATURES

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text, a column for each category."""
        dim, out = 1 << self.features.bits, np.zeros((len(texts), len(self.categories)))
        for k, w in enumerate(self.weights):
            out[:, k] = sigmoid(margins(self.features, np.append(w[:dim], w[-1]), texts) + out[:, :k] @ w[dim : dim + k])
        return out

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with p_<category> and the boolean <category> for each category; null texts count as empty."""
        kind, chain = ", ".join(f"p_{c} double" for c in self.categories), self

        @F.pandas_udf(kind)
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield pd.DataFrame(chain.probabilities(texts.tolist()), columns=[f"p_{c}" for c in chain.categories])

        new = [n for c in self.categories for n in (f"p_{c}", c)]
        got = docs.select(packed(docs, *new), scored(F.coalesce(column(text_col), F.lit(""))).alias("p"))
        found = [x for c in self.categories for x in (F.col(f"p.p_{c}"), (F.col(f"p.p_{c}") >= self.thresholds[c]).alias(c))]
        return got.select(*unpacked(got), *found)


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where out-of-fold predictions have the highest F1. Ties: the highest. A category that never occurs is never found: 1."""
    grid = np.arange(1, 20) / 20
    f1 = [2 * ((p >= t) & (y == 1)).sum() / max(1, (p >= t).sum() + (y == 1).sum()) for t in grid]
    return float(grid[len(grid) - 1 - int(np.argmax(f1[::-1]))]) if y.any() else 1.0


def train_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = 8000, max_train_bytes: int = 256 << 20, folds: int = 4, alpha: float = 5.0, l1: float = 0.5) -> ToxicityChain:
    """Fit the chain on a bounded sample of the labels that usable lets through; the categories are columns of labels.

    For each category the models without one fold and the one on all rows are fitted in tasks of their own, each of
    which holds the sample (max_train_rows and max_train_bytes bound it: see labelled_sample). Without any label all probabilities are 0.5 and nothing is found.
    """
    sample = labelled_sample(docs, labels, categories, id_col, text_col, max_train_rows, max_train_bytes, usable)
    copies = sample.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds))))
    features, dim, weights, thresholds, seen = FEATURES, 1 << FEATURES.bits, [], {}, {}

    def fitter(k: int, category: str, seen: dict[int, tuple[float, ...]]):
        def fit(got: pd.DataFrame) -> pd.DataFrame:
            got, fold = got.sort_values("key", kind="stable").reset_index(drop=True), int(got["fold"].iloc[0])
            own = (got["key"] % folds == fold).to_numpy()
            early = np.array([seen.get(x, ()) for x in got["key"]]).reshape(len(got), k)
            rows = WithMore(features.rows(got["text"].tolist()), early, dim)
            w = Ftrl(dim + k, alpha=alpha, l1=l1).fit(rows, got[category].to_numpy(float), np.flatnonzero(~own))
            if fold == folds:  # no key leaves this remainder: the model on all rows
                return pd.DataFrame({"key": [0], "label": [0], "p": [0.0], "weights": [w.tobytes()]})
            p = [float(sigmoid(x @ w[at] + w[-1])) for at, x in (rows[i] for i in np.flatnonzero(own).tolist())]
            return pd.DataFrame({"key": got["key"][own], "label": got[category][own], "p": p, "weights": [None] * len(p)})

        return fit

    for k, category in enumerate(categories):
        got = copies.groupBy("fold").applyInPandas(fitter(k, category, seen), "key long, label int, p double, weights binary").toPandas()
        final, out = got[got["weights"].notna()], got[got["weights"].isna()]
        weights.append(np.frombuffer(final["weights"].iloc[0], np.float32) if len(final) else np.zeros(dim + k + 1, np.float32))
        thresholds[category] = _best_threshold(out["p"].to_numpy(float), out["label"].to_numpy(int))
        seen = {key: (*seen.get(key, ()), p) for key, p in zip(out["key"], out["p"], strict=True)}
    return ToxicityChain(categories, weights, thresholds)
