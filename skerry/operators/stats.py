"""Counters and histograms, on the driver and over columns."""

from __future__ import annotations

import bisect
import math
import threading
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of buckets, in microseconds: powers of two up to about a minute.
LATENCY_BOUNDS = tuple(float(1 << k) for k in range(27))


class AtomicCounter:
    def __init__(self) -> None:
        self._n, self._lock = 0, threading.Lock()

    def inc(self, n: int = 1) -> None:
        self.add(n)

    def add(self, n: int) -> None:
        with self._lock:
            self._n += n

    def get(self) -> int:
        return self._n


class Histogram:
    """Counts by bucket: a value goes to the first bucket whose upper bound is above it, or to the overflow."""

    def __init__(self, bounds: tuple[float, ...] = LATENCY_BOUNDS):
        self.bounds = tuple(bounds)
        self.buckets = [0] * (len(self.bounds) + 1)
        self._n, self._sum, self._min, self._max = 0, 0.0, 0.0, 0.0
        self._lock = threading.Lock()

    def record(self, value: float) -> None:
        with self._lock:
            self.buckets[bisect.bisect_right(self.bounds, value)] += 1
            self._min = value if not self._n else min(self._min, value)
            self._max = value if not self._n else max(self._max, value)
            self._n += 1
            self._sum += value

    def count(self) -> int:
        return self._n

    def min(self) -> float:
        return self._min

    def max(self) -> float:
        return self._max

    def avg(self) -> float:
        return self._sum / self._n if self._n else 0.0

    def percentile(self, p: float) -> float:
        """Upper bound of the bucket that reaches that percentage of the values; twice the last bound for the overflow; 0 if empty."""
        if not self._n:
            return 0.0
        target, seen = math.ceil(p / 100 * self._n), 0
        for k, n in enumerate(self.buckets):
            seen += n
            if seen >= target and k < len(self.bounds):
                return self.bounds[k]
        return self.bounds[-1] * 2 if self.bounds else 0.0


def bucket_of(value: Column, bounds: tuple[float, ...]) -> Column:
    """Number of the bucket that a value goes to."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= value))


def histogram(df: DataFrame, column: str, bounds: tuple[float, ...]) -> DataFrame:
    """bucket, upper (twice the last bound for the overflow), n, cumulative: all buckets, nulls passed over."""
    spark = df.sparkSession
    edges = spark.createDataFrame([(k, float(b)) for k, b in enumerate([*bounds, bounds[-1] * 2])], "bucket int, upper double")
    got = df.where(F.col(column).isNotNull()).groupBy(bucket_of(F.col(column), bounds).alias("bucket")).agg(F.count("*").alias("n"))
    rows = F.broadcast(edges).join(got, "bucket", "left").select("bucket", "upper", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return rows.withColumn("cumulative", F.expr("sum(n) over (order by bucket)"))  # a row a bucket


def percentile(df: DataFrame, column: str, bounds: tuple[float, ...], p: float) -> DataFrame:
    """One row, ``percentile``: the upper bound of the bucket that reaches the percentage; 0 if there are no values."""
    rows = histogram(df, column, bounds)
    both = rows.agg(F.max("cumulative").alias("total"), F.collect_list(F.struct("bucket", "upper", "cumulative")).alias("b"))
    hit = F.filter(F.sort_array("b"), lambda x: x["cumulative"] >= F.ceil(F.lit(p / 100) * F.col("total")))
    return both.select(F.when(F.col("total") > 0, F.get(hit, F.lit(0))["upper"]).otherwise(0.0).alias("percentile"))


@dataclass
class IndexStats:
    docs_added: AtomicCounter = field(default_factory=AtomicCounter)
    docs_removed: AtomicCounter = field(default_factory=AtomicCounter)
    flushes: AtomicCounter = field(default_factory=AtomicCounter)
    segment_count: int = 0
    total_docs: int = 0
    deleted_docs: int = 0
    total_terms: int = 0
    disk_bytes: int = 0
    wal_bytes: int = 0


@dataclass
class QueryStats:
    queries: AtomicCounter = field(default_factory=AtomicCounter)
    latency_us: Histogram = field(default_factory=Histogram)
