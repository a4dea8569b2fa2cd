"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector, made unit length and rotated at random, is kept as the signs of its coordinates and one correction
scalar, the inner product of the rotated vector with its code. That scalar turns the code's inner product with a
query into an unbiased estimate, with a known bound of its error. A query is compared with packed codes only;
vectors whose upper bound reaches the k-th best exact cosine so far are scored exactly, and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table

OUT = "query_id long, vec_id long, which long, score double"


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix; the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and their correction scalars."""
    x = unit @ turn.T
    return np.packbits(x > 0, axis=1, bitorder="little"), np.abs(x).sum(1) / np.sqrt(x.shape[1])


def estimates(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rotated unit queries (rows) with coded vectors (columns), and each vector's error bound.

    The bound is ``width`` standard deviations of the code's error (it falls with the square root of the dimension).
    """
    dim = queries.shape[1]
    bits = np.unpackbits(codes, axis=1, count=dim, bitorder="little").astype(np.float32)
    q = queries.astype(np.float32)
    raw = (2 * (q @ bits.T) - q.sum(1, keepdims=True)) / np.sqrt(dim)
    fix = np.maximum(scalars, 1e-6)
    return raw / fix, width * np.sqrt(np.maximum(1 - fix * fix, 0)) / fix / np.sqrt(max(1, dim - 1))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def search_block(qid: np.ndarray, queries: np.ndarray, vid: np.ndarray, which: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalars: np.ndarray, turn: np.ndarray, k: int, width: float) -> pd.DataFrame:
    """The k nearest of one block's vectors for each of one block's queries."""
    found = []
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    est, err = estimates(codes, scalars, unit @ turn.T, width)
    upper = est + err
    for i in range(len(qid)):
        own = vid != qid[i]
        up = np.where(own, upper[i], -np.inf)
        n = int(own.sum())
        if not n:
            continue
        first = np.argpartition(-up, min(k, n) - 1)[: min(k, n)] if n > k else np.flatnonzero(own)
        score = exact_cosine(np.broadcast_to(queries[i], (len(first), queries.shape[1])), vectors[first])
        if n > k:
            # what may still be among the k nearest: never fewer, for any number of vectors
            rest = np.flatnonzero(up >= score.min())
            rest = rest[~np.isin(rest, first)]
            if len(rest):
                score = np.concatenate([score, exact_cosine(np.broadcast_to(queries[i], (len(rest), queries.shape[1])), vectors[rest])])
                first = np.concatenate([first, rest])
        best = np.lexsort((vid[first], -score))[:k]
        found.append(pd.DataFrame({"query_id": qid[i], "vec_id": vid[first[best]], "which": which[first[best]], "score": score[best]}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "which": [], "score": []})


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ok & F.exists("vec", lambda x: x != 0.0))


def nearest(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, seed: int = 7, width: float = 4.0, query_block: int = 1024, vector_block: int = 8192) -> DataFrame:
    """For each row that ``is_query`` (a condition on its ``id``) holds for, its ``k`` nearest other rows by cosine.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. Vectors that are null, all zero or
    hold null or non-finite components take no part, and a query meets only vectors of its own dimension. Rows
    with the same id are one query, whose own they all are, and its nearness is the largest of its vectors'; as
    candidates each of their different vectors counts, equal ones once. Queries and vectors are dealt
    into blocks of bounded size, and each pair of blocks is one unit of work; nothing is broadcast or collected
    but two counts.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = _usable(vectors, id_col, vec_col).distinct()
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query(F.col("id")))).first()
    vector_blocks, query_blocks = max(1, -(-n // vector_block)), max(1, -(-n_queries // query_block))

    # as a query a row goes to each vector block, as a vector to each query block
    blocks = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    h = F.xxhash64("id")
    as_query = rows.where(is_query(F.col("id"))).select(F.lit(True).alias("q"), "id", "vec", F.lit(0).cast("long").alias("which"), F.pmod(h, F.lit(query_blocks)).cast("int").alias("qb"), F.explode(blocks(vector_blocks)).alias("vb"))
    as_vector = rows.select(F.lit(False).alias("q"), "id", "vec", F.xxhash64("vec").alias("which"), F.explode(blocks(query_blocks)).alias("qb"), F.pmod(h, F.lit(vector_blocks)).cast("int").alias("vb"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns: dict[int, np.ndarray] = {}
        held: list[pd.DataFrame] = []

        def done() -> Iterator[pd.DataFrame]:
            if not held:
                return
            pdf = pd.concat(held)
            held.clear()
            for dim, own in pdf.groupby(pdf.vec.map(len)):
                if dim not in turns:
                    turns[dim] = rotation(dim, seed)
                queries, others = own[own.q], own[~own.q]
                if not len(queries) or not len(others):
                    continue
                v = np.array(others.vec.tolist(), dtype=np.float64)
                codes, scalars = encode(v / np.linalg.norm(v, axis=1, keepdims=True), turns[dim])
                yield search_block(queries.id.to_numpy(), np.array(queries.vec.tolist(), dtype=np.float64), others.id.to_numpy(), others.which.to_numpy(), v, codes, scalars, turns[dim], k, width)

        last = None
        for pdf in frames:
            for key, part in pdf.groupby(["qb", "vb"], sort=False):
                if key != last:
                    yield from done()
                    last = key
                held.append(part)
        yield from done()

    pairs = as_query.unionByName(as_vector).repartition(F.col("qb"), F.col("vb")).sortWithinPartitions("qb", "vb")
    # a vector that several of a query's vectors find is one
    found = pairs.mapInPandas(work, OUT).repartition("query_id").groupBy("query_id", "vec_id", "which").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
