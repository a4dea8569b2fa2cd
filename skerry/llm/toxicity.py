"""Toxicity: a logistic classifier of words whose score may not hang on which group a text mentions.

Labelled texts that hold an identity term are scored again with the term swapped for another of its kind; the
squared change of the score is part of the loss. So a term that happens to stand in toxic texts gets no weight of
its own, and neutral mentions of groups aren't taken for abuse.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import absent, fold, fresh, prepare, table, tidily

LETTERS = re.compile(r"[^\W\d_]+")

# Identity terms by kind; within a line each can stand for any other.
IDENTITY_TERMS = (
    "woman man girl boy",
    "women men girls boys",
    "female male nonbinary transgender",
    "gay lesbian bisexual straight queer heterosexual homosexual",
    "black white asian latino hispanic african american european arab indigenous",
    "muslim christian jewish hindu buddhist catholic protestant sikh atheist",
    "muslims christians jews hindus buddhists catholics protestants sikhs atheists",
    "immigrant refugee citizen foreigner migrant",
    "immigrants refugees citizens foreigners migrants",
    "disabled blind deaf autistic",
    "old young elderly teenage",
    "mexican chinese indian german french spanish turkish polish russian",
)


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


@dataclass
class ToxicityModel:
    """Weights of words, each counted once a text; ``bias`` alone is the score of a text without any of them."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0

    def score(self, text: str | None) -> float:
        z = self.bias + math.fsum(self.weights[w] for w in self.weights.keys() & words_of(text))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit_words(texts: Iterable[set[str]], labels: np.ndarray, *, swap_penalty: float = 4.0, sparsity: float = 1.2, ridge: float = 2e-4, least_df: int = 3, rounds: int = 250) -> ToxicityModel:
    """Fit on sets of words and 0/1 labels: accelerated proximal gradient with an L1 penalty to choose words, then again without it on those words.

    ``sparsity`` is in units of the largest slope that chance alone would give any of the words, so it needs no
    tuning to the number of rows. Words in fewer than ``least_df`` texts get no weight, but for
    identity terms; the floor is the same for any number of rows, so a small language's words stay. No rows give a model that scores 0 everywhere; one class alone gives its constant rate
    (kept off 0 and 1).
    """
    ids: dict[str, int] = {}
    held = [np.sort(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32)) for words in texts]  # words as numbers: a set of strings is thirty times as large
    n = len(held)
    if not n:
        return ToxicityModel()
    rate = (float(labels.sum()) + 0.5) / (n + 1)
    base = math.log(rate / (1 - rate))
    if labels.min() == labels.max():
        return ToxicityModel({}, base)
    kinds = [line.split() for line in IDENTITY_TERMS]
    identity = {t for kind in kinds for t in kind}
    df = np.bincount(np.concatenate(held), minlength=len(ids)) if ids else np.zeros(0, np.int64)
    names = sorted(w for w, k in ids.items() if df[k] >= least_df or w in identity)
    at = {w: i for i, w in enumerate(names)}
    place_of = np.full(len(ids), -1, np.int64)
    place_of[[ids[w] for w in names]] = np.arange(len(names))
    cols = [c[c >= 0] for c in (place_of[words] for words in held)]
    row = np.repeat(np.arange(n), [len(c) for c in cols])
    col = np.concatenate(cols) if cols else np.zeros(0, np.int64)
    # the swaps: each occurrence of a term, exchanged for every other one of its kind; one row of differences a swap
    terms = [t for t in names if t in identity]
    place = {t: i for i, t in enumerate(terms)}
    change, swaps = np.zeros((len(terms), len(terms))), 0
    term_at = {at[t]: t for t in terms}
    for own in cols:
        words = {term_at[c] for c in own.tolist() if c in term_at}
        for kind in kinds if words else ():
            for a in kind:
                if a in words:
                    for b in kind:
                        if b != a:
                            d = np.zeros(len(terms))
                            d[place[a]] -= 1
                            if b in place and b not in words:
                                d[place[b]] += 1
                            change += np.outer(d, d)
                            swaps += 1
    at_terms = np.array([at[t] for t in terms], np.int64)
    change = change * (swap_penalty / swaps) if swaps else change

    share = np.bincount(col, minlength=len(names)) / n
    chance = sparsity * np.sqrt(rate * (1 - rate) * share * (1 - share) * 2 * math.log(len(names) + 2) / n)

    def solve(keep: np.ndarray, l1: np.ndarray | float) -> tuple[np.ndarray, float]:
        use = keep[col]
        r, c = row[use], col[use]
        w, b, p = np.zeros(len(names)), base, np.zeros(len(names))
        pb, t = b, 1.0
        # Lipschitz bound of the mean loss from the largest row, and of the swap term
        step = 1 / (0.25 * (1 + np.sqrt(np.bincount(r, minlength=n).mean() + 1) * np.sqrt(np.bincount(c, minlength=len(names)).max(initial=1) / n * max(1, len(c) / n))) + ridge + 2 * np.abs(change).sum(0).max(initial=0))
        for _ in range(rounds):
            z = pb + np.bincount(r, weights=p[c], minlength=n)
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
            g = np.bincount(c, weights=e[r], minlength=len(names)) / n + ridge * p
            if len(terms):
                g[at_terms] += 2 * change @ p[at_terms]
            new = p - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0) * keep
            nb = pb - step * e.mean()
            t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
            p, pb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
            w, b, t = new, nb, t2
        return w, b

    chosen, _ = solve(np.ones(len(names), bool), chance)
    w, b = solve(np.abs(chosen) > 1e-6, 0.0)
    return ToxicityModel({names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-9)}, float(b))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] | None = (4, 2), most_rows: int = 6000, **options) -> ToxicityModel:
    """Fit on at most ``most_rows`` labelled rows, the first by a hash of their id (ids with ``crc32 mod held_out[0] == held_out[1]`` are left out).

    Rows without an id, a label of 0 or 1, or a document are passed over; a null text has no words. An id with
    several labels or texts gives a row for each different pair, of all of which again the first ``most_rows`` count.
    One task fits them, so that the driver gets the weights and none of the texts' words.
    """
    prepare(docs.sparkSession)
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    if held_out:
        rows = rows.where(fold(F.col("id"), held_out[0]) != held_out[1])
    some = rows.orderBy(F.xxhash64("id"), "id", "y").limit(most_rows)  # bounded, so it may be broadcast
    seen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")

    def distinct(frames):
        for pdf in frames:
            yield pd.DataFrame({"h": pdf.h, "y": pdf.y, "words": [" ".join(sorted(words_of(t))) for t in pdf.text]})

    pairs = seen.select(F.xxhash64("id").alias("h"), "y", "text").mapInPandas(tidily(distinct), "h long, y int, words string").distinct()
    def fitted(frames):
        parts = [pdf[["y", "words"]] for pdf in frames]
        if not parts:
            return
        got = pd.concat(parts)
        order = np.lexsort((got.y.to_numpy(), pd.factorize(got.words, sort=True)[0]))
        labels_, words = got.y.to_numpy(float)[order], got.words.to_numpy()[order]
        parts.clear()
        del got
        model = fit_words((set(w.split()) for w in words), labels_, **options)
        yield pd.DataFrame({"word": [None, *model.weights], "weight": [model.bias, *model.weights.values()]})

    got = pairs.orderBy("h", "y", "words").limit(most_rows).coalesce(1).mapInPandas(tidily(fitted), "word string, weight double").collect()  # a row a chosen word
    weights = {r.word: r.weight for r in got}
    return ToxicityModel(weights, weights.pop(None)) if weights else ToxicityModel()


def score_column(spark: SparkSession, model: ToxicityModel):
    """A function from a text column to a double column."""
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(frames):
        m = shared.value
        for texts in frames:
            yield pd.Series([m.score(t) for t in texts], dtype="float64")

    @F.pandas_udf(T.DoubleType())
    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidily(run)(frames)

    return score


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", as_col: str = "score") -> DataFrame:
    """The frame with one more column, the score of each whole text (the bias alone for null or empty ones).

    A repeated row is scored as often. A column that is there already raises.
    """
    absent(docs, as_col)
    return docs.withColumn(as_col, score_column(docs.sparkSession, model)(F.col(text_col)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, *, threshold: float = 0.3) -> DataFrame:
    """The rows whose score is below the threshold, with their columns as they were.

    A null or empty text has the score of the bias alone. Repeated rows stay or go together; an empty table stays empty.
    """
    name = fresh(docs, "score")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), as_col=name).where(F.col(name) < threshold).drop(name)
