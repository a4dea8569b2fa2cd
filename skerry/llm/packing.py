"""Best-fit packing of token pieces into sequences.

The histogram of lengths (at most one number a length, whatever the corpus' size) is all that the driver sees. A
configuration linear program over it, whose variables say how many sequences to fill in each way, is solved by
multiplicative weights: each round a knapsack dynamic program prices the way that fits best the lengths that lag
most. The solution is rounded down, and what remains goes, longest first, to the fullest sequence with room. The
plan is a table of runs of ranks, so pieces find their sequences by their rank among those of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TokenBytes, cut, prepare, slices, table, tidily


def knapsack(values: np.ndarray) -> list[int]:
    """Sizes, with repeats, of a selection of most value; ``values[s]`` is that of size s, and the room is ``len(values) - 1``."""
    room = len(values) - 1
    best, taken = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    v = values[1:]
    for c in range(1, room + 1):
        got = best[c - 1 :: -1] + v[:c]
        k = int(got.argmax())
        if got[k] > best[c - 1]:
            best[c], taken[c] = got[k], k + 1
        else:
            best[c] = best[c - 1]
    chosen, c = [], room
    while c:
        if taken[c]:
            chosen.append(int(taken[c]))
            c -= int(taken[c])
        else:
            c -= 1
    return chosen


def fractional(demand: np.ndarray, *, share: float = 0.1, eagerness: float = 40.0, rounds: int = 6000) -> dict[tuple[int, ...], float]:
    """How often to use each way of filling a sequence, so that every size is covered as often as demanded.

    The dual prices start at the sizes themselves and fall exponentially in the share of the size's demand that is
    covered; a round uses the best way until it has covered ``share`` of some size's demand.
    """
    sizes = np.arange(len(demand), dtype=float)
    left, some = demand.astype(float).copy(), demand > 0
    used: dict[tuple[int, ...], float] = defaultdict(float)
    for _ in range(rounds):
        if not (left > 1e-9).any():
            break
        done = np.where(some, 1 - left / np.maximum(demand, 1), 0.0)
        low = done[left > 1e-9].min()
        values = np.where(left > 1e-9, sizes * np.exp(-eagerness * (done - low)), -1.0)
        way = knapsack(values)
        times = np.bincount(way, minlength=len(demand))
        at = np.flatnonzero(times)
        x = float((np.minimum(left[at], share * np.maximum(demand[at], 1)) / times[at]).min())
        left[at] -= x * times[at]
        left[left < 1e-9] = 0
        used[tuple(sorted(way, reverse=True))] += x
    return used


def plan(counts: dict[int, int], capacity: int, *, grain: int = 8, small: int | None = None) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (length, first rank, number, first sequence) that place every piece, and the number of sequences.

    Pieces of a length have ranks from 0; the i-th of a run goes to the i-th sequence from the run's first. The
    program counts lengths in units of ``capacity / (capacity // grain)`` tokens, rounded up; pieces of up to ``small``
    tokens (a 64th of the capacity) are left for the gaps.
    """
    small = capacity // 64 if small is None else small
    counts = {k: n for k, n in counts.items() if n}
    units = max(1, capacity // max(1, min(grain, capacity // 64 or 1)))
    unit = capacity / units
    demand, members = np.zeros(units + 1, np.int64), defaultdict(list)
    for length in sorted(counts):
        if length > small:
            c = int(-(-length // unit))
            demand[c] += counts[length]
            members[c].append(length)
    ways = {w: n for w, x in sorted(fractional(demand).items()) if (n := int(x + 1e-6))}
    runs: list[tuple[int, int, int, int]] = []
    next_rank = dict.fromkeys(counts, 0)
    groups: list[tuple[int, int, int]] = []  # gap, first sequence, number of sequences
    sequences = 0

    def take(c: int, n: int) -> list[tuple[int, int]]:
        """The next n pieces of a size, as (length, number); fewer if it has no more."""
        got = []
        while n and members[c]:
            length = members[c][0]
            k = min(n, counts[length] - next_rank[length])
            if k:
                got.append((length, k))
                n -= k
                next_rank[length] += k
            if next_rank[length] == counts[length]:
                members[c].pop(0)
        return got

    for way, n in sorted(ways.items(), key=lambda x: -x[1]):
        edges, gaps = [0, n], [capacity]
        for c in way:
            at = 0
            new_edges, new_gaps = [0], []
            parts = []
            for length, k in take(c, n):
                runs.append((length, next_rank[length] - k, k, sequences + at))
                parts.append((at, at + k, length))
                at += k
            if at < n:
                parts.append((at, n, 0))
            i = 0
            for lo, hi, length in parts:
                while edges[i + 1] <= lo:
                    i += 1
                while True:
                    end = min(hi, edges[i + 1])
                    new_edges.append(end)
                    new_gaps.append(gaps[i] - length)
                    if end == hi:
                        break
                    i += 1
            edges, gaps = new_edges, new_gaps
        groups += [(g, sequences + a, b - a) for a, b, g in zip(edges, edges[1:], gaps, strict=False)]
        sequences += n
    # what the rounding left, and the small pieces: longest first, each to the smallest gap that holds it
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for g, first, n in groups:
        open_[g].append((first, n))
    order = sorted(open_)

    def put(gap: int, first: int, n: int) -> None:
        if not open_[gap]:
            bisect.insort(order, gap)
        open_[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        n = counts[length] - next_rank[length]
        while n:
            i = bisect.bisect_left(order, length)
            if i == len(order):
                k = capacity // length
                bins = max(1, n // k)
                put(capacity, sequences, bins)
                sequences += bins
                continue
            gap = order[i]
            first, have = open_[gap].pop()
            if not open_[gap]:
                order.pop(i)
            k = min(n, have)
            runs.append((length, next_rank[length], k, first))
            next_rank[length] += k
            n -= k
            if have > k:
                put(gap, first + k, have - k)
            put(gap - length, first, k)
    return runs, sequences


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every document's ids and then ``end_id``, cut after each ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""
    prepare(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = TokenBytes.at(tokenizer)
        for pdf in frames:
            texts, ids = [t or "" for t in pdf.text], list(pdf.doc_id)
            for a, b in slices([len(t) for t in texts], 1_000_000):
                rows = []
                for doc, raw in zip(ids[a:b], tokens.encode(texts[a:b]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    rows += [(doc, k, s, min(capacity, n - s), zlib.crc32(raw[4 * s : 4 * (s + capacity)])) for k, s in enumerate(range(0, n, capacity))]
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(tidily(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def assign(rows: DataFrame, *, length_col: str = "length", order: tuple[str | Column, ...] = (), capacity: int = 4096, rows_a_bucket: int = 20_000) -> DataFrame:
    """The rows with their ``sequence_id`` and ``offset``; rows that are alike in every column may change places.

    A length's rows are ranked in buckets by hash, whose counts are summed first, so a length that most rows have
    is no one task's work. The frame is read more than once, so it should be a checkpoint or a table.
    """
    spark = rows.sparkSession
    prepare(spark)
    by = [F.col(c) if isinstance(c, str) else c for c in order or [c for c in rows.columns if c != length_col]]
    histogram = {r[0]: r[1] for r in rows.groupBy(length_col).agg(F.count("*")).collect()}  # a row a length, at most capacity
    runs, _ = plan(histogram, capacity)
    runs.sort()
    n_buckets = max(1, -(-max(histogram.values(), default=0) // rows_a_bucket))
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(n_buckets)))
    before = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = bucketed.groupBy(F.col(length_col).alias("_l"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(length_col, "_bucket").orderBy(*by)
    ranked = bucketed.withColumn("_rank", F.row_number().over(within) - 1).join(firsts, (F.col(length_col) == F.col("_l")) & (F.col("_bucket") == F.col("_b"))).withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_l", "_b", "_first", "_bucket")
    # at most a few runs a length and a way of filling; their number does not grow with the rows
    shared = spark.sparkContext.broadcast(tuple(np.array(x, dtype=np.int64) for x in zip(*runs, strict=True)) if runs else tuple(np.zeros(0, np.int64) for _ in range(4)))

    @F.pandas_udf("long")
    def sequence(length: pd.Series, rank: pd.Series) -> pd.Series:
        lengths, firsts, _, starts = shared.value
        at = np.searchsorted(lengths * (1 << 40) + firsts, length.to_numpy() * (1 << 40) + rank.to_numpy(), side="right") - 1
        return pd.Series(starts[at] + rank.to_numpy() - firsts[at])

    placed = ranked.withColumn("sequence_id", sequence(F.col(length_col), F.col("_rank")))
    along = Window.partitionBy("sequence_id").orderBy(F.col(length_col).desc(), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum(length_col).over(along), F.lit(0)).cast("long")).drop("_rank")


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all rows with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece with the end id alone. A row that is repeated is packed as often; a null id
    stays null. An empty table gives no rows.
    """
    return assign(cut(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id)), order=("doc_id", "piece", "ids_crc32"), capacity=capacity)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_bpe())


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_bpe())
