"""Writing an index: documents to segments, deletes, merges, versions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer, counted
from ..sources.schema import InvalidArgumentError, Schema
from ..sources.store import Manifest, SegmentMeta, Store
from ..sources.wal import WriteAheadLog
from .reader import IndexReader
from .stats import IndexStats


TABLES = ("docs", "postings", "term_dict")
#: A stream repeats its last batch only, so ids of long past ones needn't be known.
BATCHES_KEPT = 1000


@dataclass(frozen=True)
class IndexWriterOptions:
    index_dir: str
    schema: Schema
    external_id_field: str = "doc_id"
    max_docs_per_segment: int = 5_000_000
    analyzer: Analyzer = Analyzer()
    remove_is_noop: bool = False


def documents_of(df: DataFrame, schema: Schema, external_id_field: str) -> DataFrame:
    """external_id, texts (an array of values a TEXT field) and stored (the first value of each stored field, "" for none).

    Columns are fields by name; an array column holds several values of its field. Columns that the schema doesn't
    know are passed over.
    """
    kinds = dict(df.dtypes)

    def values(name: str):
        if name not in kinds:
            return F.array().cast("array<string>")
        c = F.col(f"`{name}`")
        return F.filter(c.cast("array<string>"), lambda x: x.isNotNull()) if kinds[name].startswith("array") else F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c.cast("string")))

    first = lambda name: F.coalesce(F.get(values(name), F.lit(0)), F.lit(""))
    texts = [F.coalesce(values(n), F.array().cast("array<string>")).alias(n) for n in schema.text_fields]
    stored = [first(n).alias(n) for n in schema.stored_fields]
    return df.select(first(external_id_field).alias("external_id"), F.struct(*(texts or [F.lit(None).alias("_")])).alias("texts"), F.struct(*(stored or [F.lit(None).cast("string").alias("_")])).alias("stored"))


def analyzed(docs: DataFrame, schema: Schema, analyzer: Analyzer) -> DataFrame:
    """The documents with ``tokens``, an array a text field of the tokens of all its values."""
    per = [analyzer.tokens_of(F.col("texts")[n]) for n in schema.text_fields]
    return docs.withColumn("tokens", F.array(*per) if per else F.array().cast("array<array<string>>")).drop("texts")


def postings_of(docs: DataFrame) -> DataFrame:
    """segment_id, term, doc_id, tf, doc_length of frames with doc_length and terms, the counted tokens of a document a row."""
    return docs.select("segment_id", "doc_id", "doc_length", F.inline("terms")).select("segment_id", "term", "doc_id", "tf", "doc_length")


class IndexWriter:
    """Adds, removes and merges. A new writer of a folder that holds an index goes on from its last version.

    One writer a folder at a time: a second one that publishes the same version fails. Documents are pending, in the
    log only, until ``flush``; readers see flushed segments of the version that they were opened at.
    """

    def __init__(self, spark: SparkSession, options: IndexWriterOptions):
        o = options
        if not o.index_dir:
            raise InvalidArgumentError("the index folder is empty")
        if not o.schema.stored_field_count and not o.schema.indexed_field_count:
            raise InvalidArgumentError("the schema has no stored and no indexed TEXT field")
        self.spark, self.options, self.schema = spark, o, o.schema
        self.store, self.wal, self.stats = Store(spark, o.index_dir), WriteAheadLog(spark, o.index_dir), IndexStats()
        if self.store.versions():
            self.manifest, _ = self.store.load()
        else:
            self.manifest = Manifest()
            self.store.publish(self.manifest, self.schema)
        self._pending: list[int] = self.wal.batches()  # what an earlier writer had logged and not flushed

    open = classmethod(lambda cls, spark, options: cls(spark, options))

    def __enter__(self) -> IndexWriter:
        return self

    def __exit__(self, kind, *rest) -> None:
        if kind is None:
            self.flush()

    # adding
    def _live_ids(self) -> DataFrame:
        docs = self.store.table("docs", self.manifest.ids, "segment_id long, doc_id int, external_id string")
        live = docs.join(self.store.deletes(self.manifest), ["segment_id", "doc_id"], "left_anti").select("external_id")
        pending = self.wal.replay().where("op = 'ADD'").select("external_id") if self._pending else None
        return live.unionByName(pending) if pending is not None else live

    def add_documents(self, df: DataFrame, *, on_invalid: str = "raise") -> DataFrame | None:
        """Log a batch. Ids that are missing, empty, repeated in the batch or taken raise, or with ``on_invalid="reject"``
        are left out (of repeated ones the first stays) and returned with the reason, in a table that stays until ``vacuum``.
        """
        o = self.options
        docs = documents_of(df, self.schema, o.external_id_field).withColumn("order", F.monotonically_increasing_id())
        taken = self._live_ids().select(F.col("external_id").alias("taken")).distinct()
        pairs = lambda n: F.transform(F.col("texts")[n], lambda v: F.struct(F.lit(n).alias("name"), v.alias("value")))
        fields = [pairs(n) for n in self.schema.text_fields]
        stored = [F.array(F.struct(F.lit(n).alias("name"), F.col("stored")[n].alias("value"))) for n in self.schema.stored_fields if n not in self.schema.text_fields]
        logged = [F.col("order").alias("internal_id"), "external_id", F.flatten(F.array(*fields, *stored)).alias("fields")]

        def reasoned(ids: DataFrame) -> DataFrame:
            """Of a frame with external_id and n, the count or place of its repeats: with the reason to refuse a row."""
            reason = F.when(F.col("external_id") == "", "missing or empty external id").when(F.col("n") > 1, "repeated external id").when(F.col("taken").isNotNull(), "taken external id")
            return ids.join(taken, F.col("external_id") == F.col("taken"), "left").withColumn("reason", reason)

        def refuse(records: DataFrame) -> None:
            if found := reasoned(records.groupBy("external_id").agg(F.count("*").alias("n"))).where("reason is not null").first():
                raise InvalidArgumentError(f"{found.reason}: {found.external_id!r}")

        kept = None
        if on_invalid == "raise":  # texts stay where they are; of what is written, only ids are compared
            self._pending.append(self.wal.append_add(docs.select(*logged), refuse))
        else:
            first = F.row_number().over(Window.partitionBy("external_id").orderBy("order"))
            checked = reasoned(docs.withColumn("n", F.when(F.col("external_id") == "", 0).otherwise(first)))
            name = f"rejected/{uuid.uuid4().hex}"  # written before the log changes, as the check depends on it
            checked.where("reason is not null").select("external_id", "reason").write.parquet(f"{self.store.path}/{name}")
            kept = self.spark.read.schema("external_id string, reason string").parquet(f"{self.store.path}/{name}")
            self._pending.append(self.wal.append_add(checked.where("reason is null").select(*logged)))
        self.stats.docs_added.inc(self.wal.records(self._pending[-1:]).count())
        return kept

    def add_document(self, document: dict[str, str | list[str]]) -> None:
        """One document; for many, ``add_documents`` is a single job."""
        names = [f.name for f in self.schema.fields if f.name in document] or [self.options.external_id_field]
        row = {n: [document[n]] if isinstance(document.get(n), str) else document.get(n) for n in names}
        self.add_documents(self.spark.createDataFrame([row], ", ".join(f"`{n}` array<string>" for n in names)))

    def pending_postings(self) -> int:
        """Number of postings that a flush would write."""
        return self._postings_of_pending().count() if self._pending else 0

    def _documents_of_pending(self) -> DataFrame:
        rows = self.wal.live(self._pending)
        value = lambda n: F.transform(F.filter("fields", lambda x: x["name"] == n), lambda x: x["value"])
        texts = [value(n).alias(n) for n in self.schema.text_fields] or [F.lit(None).alias("_")]
        stored = [F.coalesce(F.get(value(n), F.lit(0)), F.lit("")).alias(n) for n in self.schema.stored_fields] or [F.lit(None).cast("string").alias("_")]
        return rows.select("batch", "internal_id", "external_id", F.struct(*texts).alias("texts"), F.struct(*stored).alias("stored"))

    def _postings_of_pending(self) -> DataFrame:
        docs = self._documents_of_pending().withColumn("segment_id", F.lit(0)).withColumn("doc_id", F.xxhash64("external_id"))
        docs = analyzed(docs, self.schema, self.options.analyzer).withColumn("tokens", F.flatten("tokens"))
        return postings_of(docs.withColumn("doc_length", F.size("tokens")).withColumn("terms", counted(F.col("tokens"))))

    # segments
    def flush(self, *, batch_id: str | None = None) -> list[int]:
        """Write what is pending as new segments and publish them; returns their ids. Nothing pending: nothing done.

        A batch id that an earlier flush had makes this one drop what is pending (for streams that repeat a batch).
        """
        if batch_id is not None and batch_id in self.manifest.batches or not self._pending:
            self.wal.truncate()
            self._pending = []
            return []
        docs, n = self._numbered(self._documents_of_pending())
        if not n:
            self.wal.truncate()
            self._pending = []
            return []
        parts, start = -(-n // self.options.max_docs_per_segment), self.manifest.next_segment
        size = -(-n // parts)
        docs = docs.withColumn("segment_id", (F.floor(F.col("number") / size) + start).cast("long")).withColumn("doc_id", (F.col("number") % size).cast("int")).drop("number")
        metas = self._write(analyzed(docs, self.schema, self.options.analyzer), list(range(start, start + parts)))
        m = self.manifest
        batches = (*m.batches, batch_id)[-BATCHES_KEPT:] if batch_id is not None else m.batches
        self._publish(replace(m, segments=(*m.segments, *metas), next_segment=start + parts, batches=batches))
        self.wal.truncate()
        self._pending = []
        self.stats.flushes.inc()
        return [s.segment_id for s in metas]

    @staticmethod
    def _numbered(docs: DataFrame) -> tuple[DataFrame, int]:
        """The documents with ``number``, from 0 in the order in which they were added, and how many there are.

        An internal id holds the partition that a document came in and its place there. Numbers are counts of the partitions
        before, and that place; no row but counts and ids meets others.
        """
        part = (F.col("batch"), F.shiftright("internal_id", 33).alias("part"))
        counts = docs.groupBy(*part).agg(F.count("*").alias("n"), F.max(F.col("internal_id").bitwiseAND((1 << 33) - 1)).alias("last")).toPandas()  # a row a partition
        counts = counts.sort_values(["batch", "part"])
        n = int(counts.n.sum())
        if not n:
            return docs, 0
        counts["first"] = counts.n.cumsum() - counts.n
        firsts = docs.sparkSession.createDataFrame([tuple(map(int, x)) for x in counts[["batch", "part", "first"]].itertuples(index=False)], "batch long, part int, first long")
        place = F.col("internal_id").bitwiseAND((1 << 33) - 1)
        if (counts["last"] + 1 != counts.n).any():  # some were rejected, or removed before they were flushed
            ids = docs.select("batch", "internal_id", part[1])
            ids = ids.withColumn("place", F.row_number().over(Window.partitionBy("batch", "part").orderBy("internal_id")) - 1).drop("part")
            docs, place = docs.join(ids, ["batch", "internal_id"]), F.col("place")
        docs = docs.withColumn("part", F.shiftright("internal_id", 33).cast("int")).join(F.broadcast(firsts) if len(counts) <= 100_000 else firsts, ["batch", "part"])
        return docs.withColumn("number", F.col("first") + place).drop("batch", "internal_id", "part", "place", "first"), n

    def _clear(self, ids: list[int]) -> None:
        """Remove what an attempt that failed before it was published has left of segments."""
        for t in TABLES:
            for i in ids:
                self.store.delete(f"{t}/segment_id={i}")

    def _write(self, docs: DataFrame, ids: list[int]) -> list[SegmentMeta]:
        """Write the tables of new segments from analysed documents, which are written once and read for each table."""
        self._clear(ids)
        staged = f"{self.store.path}/staging/{uuid.uuid4().hex}"
        lengths = F.transform("tokens", lambda x: F.size(x))
        docs.select("segment_id", "doc_id", "external_id", F.aggregate(lengths, F.lit(0), lambda a, x: a + x).alias("doc_length"), lengths.alias("field_lengths"), "stored", counted(F.flatten("tokens")).alias("terms")).write.parquet(staged)
        docs = self.spark.read.parquet(staged)
        self._write_ranges("docs", ids, docs.drop("terms"), "doc_id")
        self._write_postings(postings_of(docs), ids)
        metas = self._metas(ids)
        self.store.delete(staged.removeprefix(f"{self.store.path}/"))
        return metas

    def _write_postings(self, postings: DataFrame, ids: list[int]) -> None:
        # ranges of (term, document): files hold few terms each, and a term that most documents have is spread
        self._write_ranges("postings", ids, postings, "term", "doc_id")

    def _write_ranges(self, table: str, ids: list[int], rows: DataFrame, *by: str) -> None:
        """Write rows of segments in ranges, sorted.

        A single segment isn't sorted by: sorts compare the first bytes of their first column, which tell nothing where it is constant.
        """
        path = f"{self.store.path}/{table}"
        if len(ids) == 1:
            rows.drop("segment_id").repartitionByRange(*by).sortWithinPartitions(*by).write.mode("append").parquet(f"{path}/segment_id={ids[0]}")
        else:
            rows.repartitionByRange("segment_id", *by).sortWithinPartitions("segment_id", *by).write.mode("append").partitionBy("segment_id").parquet(path)

    def _metas(self, ids: list[int]) -> list[SegmentMeta]:
        docs = self.store.table("docs", ids, "segment_id long, doc_id int, doc_length int")
        got = {r.segment_id: r for r in docs.groupBy("segment_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("t")).collect()}
        postings = self.store.table("postings", [i for i in ids if self.store.exists(f"postings/segment_id={i}")], "segment_id long, term string, doc_id int")
        terms = postings.groupBy("segment_id", "term").agg(F.count("*").cast("int").alias("doc_freq"))
        self._write_ranges("term_dict", ids, terms, "term")
        return [SegmentMeta(i, got[i].n, got[i].t, got[i].t / got[i].n if got[i].t else 0.0) for i in ids if i in got]

    def _publish(self, manifest: Manifest) -> None:
        manifest = replace(manifest, version=self.manifest.version + 1)
        self.store.publish(manifest, self.schema)
        self.manifest = manifest

    # removing
    def remove_documents(self, ids: DataFrame) -> None:
        """Of a frame whose first column holds external ids: hide their documents, in every segment, from readers opened later.

        With ``remove_is_noop`` the removal is only logged and counted.
        """
        ids = ids.select(F.col(ids.columns[0]).cast("string").alias("external_id"))
        batch = self.wal.append_remove(ids)
        self.stats.docs_removed.inc(self.wal.records([batch]).count())
        if self.options.remove_is_noop:
            return
        logged = self.wal.records([batch]).select("external_id").distinct()
        docs = self.store.table("docs", self.manifest.ids, "segment_id long, doc_id int, external_id string")
        version = self.manifest.version + 1
        docs.join(logged, "external_id", "left_semi").select("segment_id", "doc_id").write.mode("overwrite").parquet(f"{self.store.path}/deletes/version={version}")
        self._publish(replace(self.manifest, delete_versions=(*self.manifest.delete_versions, version)))

    def remove_document(self, external_id: str) -> None:
        self.remove_documents(self.spark.createDataFrame([(external_id,)], "external_id string"))

    def remove_segments(self, ids: list[int]) -> None:
        """A version without these segments; their files stay for readers of earlier versions."""
        m = self.manifest
        self._publish(replace(m, segments=tuple(s for s in m.segments if s.segment_id not in ids)))

    # merging
    def merge(self, ids: list[int], *, new_id: int | None = None, publish: bool = True, purge: bool = True) -> SegmentMeta:
        """Join segments, in the order given, to one. Document ids follow on; deleted documents go unless ``purge`` is false.

        With ``publish`` the new segment takes the others' place; without, it is only written. An id that any kept version uses is refused.
        """
        if not ids:
            raise InvalidArgumentError("no segments to merge")
        known = {s.segment_id: s for s in self.manifest.segments}
        if missing := [i for i in ids if i not in known]:
            raise InvalidArgumentError(f"unknown segments {missing}")
        target = self.manifest.next_segment if new_id is None else new_id
        if any(target in self.store.load(v)[0].ids for v in self.store.versions()):
            raise InvalidArgumentError(f"segment {target} is in use")
        self._clear([target])
        spark = self.spark
        dead = self.store.deletes(self.manifest).where(F.col("segment_id").isin(ids)) if purge else None
        first, offsets = 0, []
        for i in ids:
            offsets.append((i, first))
            first += known[i].doc_count
        offset = spark.createDataFrame(offsets, "segment_id long, first int")  # a row a segment

        def moved(name: str, schema: str) -> DataFrame:
            rows = self.store.table(name, [i for i in ids if self.store.exists(f"{name}/segment_id={i}")], schema)
            rows = rows.join(dead, ["segment_id", "doc_id"], "left_anti") if dead is not None else rows
            return rows.join(F.broadcast(offset), "segment_id").withColumn("doc_id", F.col("doc_id") + F.col("first")).drop("first")

        docs, postings = moved("docs", self.docs_schema()), moved("postings", "segment_id long, term string, doc_id int, tf int, doc_length int")
        if purge and not dead.isEmpty():
            # close the gaps: by counts of deleted documents before each, in ranges of ids
            renumber = docs.select(F.col("doc_id").alias("old"), F.floor(F.col("doc_id") / 65536).alias("range"))
            within = Window.partitionBy("range").orderBy("old")
            counts = renumber.groupBy("range").agg(F.count("*").alias("k"))
            base = counts.select("range", F.coalesce(F.sum("k").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for 65,536 documents
            renumber = renumber.withColumn("k", F.row_number().over(within) - 1).join(base, "range").select("old", (F.col("k") + F.col("base")).cast("int").alias("new"))
            swap = lambda rows: rows.join(renumber, rows["doc_id"] == renumber["old"]).withColumn("doc_id", F.col("new")).drop("old", "new")
            docs, postings = swap(docs), swap(postings)
        here = lambda rows: rows.withColumn("segment_id", F.lit(target).cast("long"))
        here(docs).write.mode("append").partitionBy("segment_id").parquet(f"{self.store.path}/docs")
        self._write_postings(here(postings), [target])
        n = self.store.table("docs", [target], "segment_id long, doc_id int").count() if self.store.exists(f"docs/segment_id={target}") else 0
        self._metas([target])
        total = sum(known[i].truncated_terms for i in ids)
        if n != first:
            total = self.store.table("docs", [target], "segment_id long, doc_length int").agg(F.sum("doc_length")).first()[0] or 0 if n else 0
        meta = SegmentMeta(target, n, total, total / n if n else 0.0)
        if publish:
            m = self.manifest
            rest = tuple(s for s in m.segments if s.segment_id not in ids)
            deletes = m.delete_versions
            if deletes and purge:  # what is purged needn't be hidden any more
                left = self.store.deletes(m).where(F.col("segment_id").isin([s.segment_id for s in rest]))
                left.write.mode("overwrite").parquet(f"{self.store.path}/deletes/version={m.version + 1}")
                deletes = () if left.isEmpty() else (m.version + 1,)
            self._publish(replace(m, segments=(*rest, *([meta] if n else [])), next_segment=max(m.next_segment, target + 1), delete_versions=deletes))
        return meta

    def docs_schema(self) -> str:
        stored = ", ".join(f"`{n}`: string" for n in self.schema.stored_fields) or "_: string"
        return f"segment_id long, doc_id int, external_id string, doc_length int, field_lengths array<int>, stored struct<{stored}>"

    def vacuum(self, *, keep_versions: int = 1) -> list[int]:
        """Delete the files of segments and deletes, the manifests, the left-overs and the lists of rejected documents that none of the last versions needs; returns the segments."""
        known = self.store.versions()
        kept, old = known[-max(1, keep_versions) :], known[: -max(1, keep_versions)]
        manifests = [self.store.load(v)[0] for v in kept]
        used, hidden = {i for m in manifests for i in m.ids}, {v for m in manifests for v in m.delete_versions}
        numbers = lambda t: {int(n.partition("=")[2]) for n in self.store.names(t) if "=" in n}
        gone = sorted({i for t in TABLES for i in numbers(t)} - used)
        self._clear(gone)
        for v in numbers("deletes") - hidden:
            self.store.delete(f"deletes/version={v}")
        for v in old:
            self.store.delete(f"manifests/{v}.json")
        for name in ("staging", "rejected"):
            self.store.delete(name)
        return gone

    def get_reader(self, **options) -> IndexReader:
        """A reader of the flushed segments as they are now."""
        return IndexReader(self.spark, self.options.index_dir, version=self.manifest.version, **options)

    def refresh_reader(self) -> IndexReader:
        """Flush, then a reader that sees it all."""
        self.flush()
        return self.get_reader()

    def index_stats(self) -> IndexStats:
        """The counters, and sizes read from the tables."""
        s = self.stats
        s.segment_count, s.total_docs = len(self.manifest.segments), self.manifest.total_docs
        s.deleted_docs = self.store.deletes(self.manifest).where(F.col("segment_id").isin(self.manifest.ids)).count()
        s.total_terms = self.store.table("term_dict", self.manifest.ids, "segment_id long, term string").select("term").distinct().count()
        s.disk_bytes = self.store.size()
        s.wal_bytes = self.wal.bytes_written()
        return s
