"""Write-ahead log: each batch of operations is a Parquet folder, written before the index changes."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Store, empty

RECORD = "batch long, seq long, op string, internal_id long, external_id string, fields array<struct<name: string, value: string>>"


@dataclass
class RecoveryState:
    """What a log holds: the largest internal id (0 for none), its added documents, and its removed ids, in log order."""

    next_internal_id: int
    active_docs: DataFrame
    removed_ids: DataFrame


class WriteAheadLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)
        self._next = max((int(n) for n in self.store.names("wal")), default=-1) + 1

    def _append(self, rows: DataFrame) -> int:
        batch = self._next
        rows.write.parquet(f"{self.store.path}/wal/{batch}")
        self._next += 1
        return batch

    def append(self, rows: DataFrame) -> int:
        """Operations of both kinds in the order of a frame with op (ADD or REMOVE), internal_id, external_id and fields; returns the batch's number."""
        return self._append(rows.select(F.lit(self._next).cast("long").alias("batch"), F.monotonically_increasing_id().alias("seq"), "op", F.col("internal_id").cast("long").alias("internal_id"), F.col("external_id").cast("string").alias("external_id"), "fields"))

    def append_add(self, docs: DataFrame, check: Callable[[DataFrame], None] | None = None) -> int:
        """Of a frame with internal_id, external_id and fields; returns the batch's number.

        With ``check`` the records are written beside the log, shown to it, and moved into the log unless it raises.
        """
        rows = docs.select(F.lit(self._next).cast("long").alias("batch"), F.monotonically_increasing_id().alias("seq"), F.lit("ADD").alias("op"), F.col("internal_id").cast("long").alias("internal_id"), "external_id", "fields")
        if check is None:
            return self._append(rows)
        batch, staged = self._next, f"staging/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.path}/{staged}")
        try:
            check(self.spark.read.schema(RECORD).parquet(f"{self.store.path}/{staged}"))
        except BaseException:
            self.store.delete(staged)
            raise
        self.store.move(staged, f"wal/{batch}")
        self._next += 1
        return batch

    def append_remove(self, ids: DataFrame) -> int:
        none = F.lit(None).cast("array<struct<name: string, value: string>>").alias("fields")
        return self._append(ids.select(F.lit(self._next).cast("long").alias("batch"), F.monotonically_increasing_id().alias("seq"), F.lit("REMOVE").alias("op"), F.lit(None).cast("long").alias("internal_id"), F.col("external_id").cast("string").alias("external_id"), none))

    def batches(self) -> list[int]:
        """Those that are whole; one whose write broke off doesn't count."""
        return [int(n) for n in self.store.names("wal") if self.store.exists(f"wal/{n}/_SUCCESS")]

    def records(self, batches: list[int] | None = None) -> DataFrame:
        got = self.batches() if batches is None else batches
        if not got:
            return empty(self.spark, RECORD)
        return self.spark.read.schema(RECORD).parquet(*[f"{self.store.path}/wal/{b}" for b in got])

    def sync(self) -> None:
        """Nothing to do: a batch is on disk once its write returns."""

    def truncate(self) -> None:
        self.store.delete("wal")

    def recover(self) -> RecoveryState:
        """The records as they are: a REMOVE doesn't cancel an earlier ADD here (see ``replay``)."""
        rows = self.records()
        most = rows.agg(F.max("internal_id")).first()[0]
        return RecoveryState(most or 0, rows.where("op = 'ADD'"), rows.where("op = 'REMOVE'").select("batch", "seq", "external_id"))

    def replay(self) -> DataFrame:
        """The last operation of each external id."""
        last = Window.partitionBy("external_id").orderBy(F.desc("batch"), F.desc("seq"))
        return self.records().withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")

    def live(self, batches: list[int]) -> DataFrame:
        """The added documents of some batches that no later operation has removed or replaced.

        Only ids are compared; without a removal in the log there is nothing to compare, as no id is added twice.
        """
        added = self.records(batches).where("op = 'ADD'")
        if self.records().where("op = 'REMOVE'").isEmpty():
            return added
        last = self.records().groupBy("external_id").agg(F.max(F.struct("batch", "seq")).alias("at")).select(F.col("at.batch").alias("batch"), F.col("at.seq").alias("seq"))
        return added.join(last, ["batch", "seq"], "left_semi")

    def bytes_written(self) -> int:
        """Bytes of the operations, their ids and kinds, without the fields' values."""
        return self.records().agg(F.coalesce(F.sum(F.octet_length("external_id") + F.when(F.col("op") == "ADD", 7).otherwise(3)), F.lit(0))).first()[0]
