"""Ranking functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (tf, doc_freq, doc_length, total_docs, avgdl) to a score; users may pass their own.
Scorer = Callable[[Column, Column, Column, Column, Column], Column]


@dataclass(frozen=True)
class BM25Params:
    k1: float = 1.2
    b: float = 0.75


def idf(doc_freq: Column, total_docs: Column) -> Column:
    """Natural logarithm, above 0 for any document frequency."""
    return F.log((total_docs - doc_freq + 0.5) / (doc_freq + 0.5) + 1.0)


def bm25(params: BM25Params | None = None) -> Scorer:
    p = params or BM25Params()

    def score(tf: Column, doc_freq: Column, doc_length: Column, total_docs: Column, avgdl: Column) -> Column:
        return idf(doc_freq, total_docs) * (tf * (p.k1 + 1)) / (tf + p.k1 * (1 - p.b + p.b * doc_length / avgdl))

    return score


def combine(scores: Column) -> Column:
    """Sum of an array of scores; 0 for none."""
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
