"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate steps, elastic net), then calibrated by one temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import absent, cut, fold, prepare, table

UNKNOWN = "und"
BITS = 15
ORDERS = (1, 2, 3)
MOST_SENT = 10_000  # languages whose shares are sent to all tasks


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of the whole lower-cased text, between two spaces: distinct buckets, rising, and their counts."""
    chars = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.zeros(1 << BITS, np.int64)
    h = np.zeros(len(chars), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(chars) < order:
            break
        h = (h[: len(chars) - order + 1] ^ chars[order - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if order in ORDERS:
            counts += np.bincount(h >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # a row a bucket, a column a language
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language (ties: the first by code point) and its calibrated probability; ``und`` and 0 without a letter or a learned language."""
        if not text or not self.languages or not _has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(*grams(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_grams(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], *, alpha: float = 0.5, l1: float = 1e-3, l2: float = 1e-3, passes: int = 4, calibrate: int = 5) -> LanguageModel:
    """Fit on gram counts in the order given; each ``calibrate``-th row only sets the temperature.

    No rows give a model that knows no language.
    """
    names = sorted(set(langs))
    idf = np.zeros(1 << BITS)
    if not rows:
        return LanguageModel([], idf, np.zeros((1 << BITS, 0)), np.zeros(0))
    df = np.zeros(1 << BITS)
    for at, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    model = LanguageModel(names, idf, np.zeros((1 << BITS, len(names))), np.zeros(len(names)))
    y = np.array([names.index(x) for x in langs])
    kept = [i for i in range(len(rows)) if i % calibrate] or list(range(len(rows)))
    apart = [i for i in range(len(rows)) if not i % calibrate]
    z, n = np.zeros((1 << BITS, len(names))), np.zeros((1 << BITS, len(names)))
    zb, nb = np.zeros(len(names)), np.zeros(len(names))

    def weights(z, n):
        w = -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    for _ in range(passes):
        for i in kept:
            at, counts = rows[i]
            x = model.features(at, counts)
            w, b = weights(z[at], n[at]), weights(zb, nb)
            e = _softmax(x @ w + b)
            e[y[i]] -= 1
            g = x[:, None] * e
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            zb += e - (np.sqrt(nb + e * e) - np.sqrt(nb)) / alpha * b
            nb += e * e
    model.weights, model.bias = weights(z, n), weights(zb, nb)
    scores = np.array([model.logits(*rows[i]) for i in apart])
    loss = lambda t: -np.log(np.maximum(_softmax(scores / t)[np.arange(len(apart)), y[apart]], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return model


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] | None = (5, 0), most_rows: int = 1200, **options) -> LanguageModel:
    """Fit on at most ``most_rows`` rows of each language, the first by a hash of their id.

    Rows without a language, an id, or a letter in their text are passed over, and so are ids with
    ``crc32 mod held_out[0] == held_out[1]``.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null and id is not null")
    if held_out:
        rows = rows.where(fold(F.col("id"), held_out[0]) != held_out[1])
    # a share of each language by hash, about twice the rows wanted, before they are ranked
    # a row a language: sent to all tasks, so that only the chosen texts move
    spread = 1 << 40
    shares = cut(rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit((2.0 * most_rows + 64) * spread) / F.col("n")).alias("below")))
    if shares.count() <= MOST_SENT:
        shares = F.broadcast(shares)
    some = rows.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(spread))).join(shares, "lang").where("h < below").withColumn("rank", F.expr("row_number() over (partition by lang order by h, id)")).where(F.col("rank") <= most_rows)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf[[_has_letter(t) for t in pdf.text]]
            got = [grams(t) for t in pdf.text]
            yield pd.DataFrame({"lang": pdf.lang, "rank": pdf["rank"], "at": [a.astype("<u4").tobytes() for a, _ in got], "n": [c.astype("<u4").tobytes() for _, c in got]})

    got = some.select("lang", "rank", "text").mapInPandas(count, "lang string, rank int, at binary, n binary").toPandas()
    got = got.sort_values(["rank", "lang", "at", "n"])  # languages in turn
    rows_ = [(np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(n, "<u4")) for a, n in zip(got["at"], got["n"], strict=True)]
    return fit_grams(rows_, list(got.lang), **options)


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", as_col: str = "language") -> DataFrame:
    """The frame with one more column, a struct of ``lang_pred`` and ``score``; a column of that name raises.

    Null texts and those without a letter are ``und`` with a score of 0; repeated rows get the same prediction each.
    """
    absent(docs, as_col)
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn(as_col, run(F.col(text_col)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")
