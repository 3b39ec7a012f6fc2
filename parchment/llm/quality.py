"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import column, without, write_table
from parchment.llm.linear import Features, Ftrl, margins, sigmoid


def labelled_sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], id_col: str, text_col: str, max_rows: int, max_bytes: int, usable: Column | None = None) -> DataFrame:
    """At most max_rows labelled texts of at most max_bytes together (key, text and the labels as 0 or 1); the same ones each time.

    A document with several label rows gets their mean, rounded. Labels without a document, and documents with a
    null label, are left out. The ids drawn, those of least hash, are broadcast: max_rows bounds them. Of the rows of an id one is
    taken, the one of least hash of its text. Texts are whole; one of over a 64th of max_bytes isn't drawn, and
    in order of the hash those are taken that max_bytes has room for. The sample is written, so it is drawn once.
    """
    one = labels.filter(usable if usable is not None else F.lit(True)).dropna(subset=[id_col, *label_cols])
    one = one.groupBy(column(id_col).alias("id")).agg(*[(F.avg(column(c)) >= 0.5).cast("int").alias(f"label_{k}") for k, c in enumerate(label_cols)])
    known = [f"label_{k}" for k in range(len(label_cols))]
    drawn = one.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(max_rows)
    texts = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text")).filter(F.octet_length("text") <= max_bytes // 64)
    texts = texts.join(F.broadcast(drawn), "id").groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), *[F.first(k).alias(k) for k in known])
    texts = write_table(texts.select(F.xxhash64("id", F.lit("sample")).alias("order"), F.xxhash64("id").alias("key"), "text", F.octet_length("text").alias("bytes"), *known), "labelled")
    # the window sees no texts and max_rows rows at most
    room = texts.select("key", F.sum("bytes").over(Window.orderBy("order", "key").rowsBetween(Window.unboundedPreceding, 0)).alias("upto")).filter(F.col("upto") <= max_bytes)
    return texts.join(F.broadcast(room), "key").select("key", "text", *[F.col(k).alias(c) for k, c in zip(known, label_cols, strict=True)])


@dataclass(frozen=True)
class QualityModel:
    features: Features
    weights: np.ndarray

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """docs with out, from 0 to 1: sparse dot products of the whole texts with the weights. Null counts as empty."""
        features, weights = self.features, self.weights

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(sigmoid(margins(features, weights, texts.tolist())))

        return docs.select(*without(docs, out), scored(F.coalesce(column(text_col), F.lit(""))).alias(out))


def train_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = 8000, max_train_bytes: int = 256 << 20, features: Features = Features(), alpha: float = 2.0, l1: float = 0.2) -> QualityModel:  # noqa: B008
    """Fit the model on a bounded sample of the label rows that usable lets through.

    max_train_rows and max_train_bytes bound the sample, see labelled_sample; one task holds it and makes the updates one text after
    another. Without any label the weights are 0 and every score is 0.5.
    """
    sample = labelled_sample(docs, labels, [label_col], id_col, text_col, max_train_rows, max_train_bytes, usable)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"key": [], "text": [], label_col: []}), *batches]).sort_values(["key", label_col], kind="stable")
        weights = Ftrl(1 << features.bits, alpha=alpha, l1=l1).fit(features.rows(got["text"].tolist()), got[label_col].to_numpy(float))
        yield pd.DataFrame({"weights": [weights.tobytes()]})

    got = sample.repartition(1).mapInPandas(fit, "weights binary").first()
    return QualityModel(features, np.frombuffer(bytes(got[0]), np.float32) if got else np.zeros((1 << features.bits) + 1, np.float32))
