"""Searching an index at one version."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import Scorer, bm25
from ..plans.query import Query
from ..sources.store import POSTINGS, TERM_DICT, Store, empty
from .stats import QueryStats

#: Postings of a block, and hits whose documents are looked up by literal ids.
BLOCK, MOST_LITERALS = 128, 1000
HITS = "external_id string, score float, segment_id long, doc_id int"


@dataclass(frozen=True)
class SearchResult:
    """The best hits in order, at most as many as asked for. ``total_hits`` is their number; ``total_matches`` that of all matches, if it was asked for."""

    docs: list
    total_hits: int
    total_matches: int | None
    elapsed_us: int


class IndexReader:
    """Sees the segments and deletes of its version, whatever is written later; it may outlive its writer.

    ``df_scope`` is what a term's document frequency counts: its own segment ("segment") or all ("global").
    Document number and mean length are those of the whole version, deleted documents included.
    """

    def __init__(self, spark: SparkSession, path: str, *, version: int | None = None, scorer: Scorer | None = None, df_scope: str = "segment", exact_float: bool = True):
        self.spark, self.store = spark, Store(spark, path)
        self.manifest, self.schema = self.store.load(version)
        self.scorer, self.df_scope, self.exact_float, self.stats = scorer or bm25(), df_scope, exact_float, QueryStats()

    # tables
    def _table(self, name: str, schema: str) -> DataFrame:
        return self.store.table(name, [i for i in self.manifest.ids if self.store.exists(f"{name}/segment_id={i}")], schema)

    def postings(self) -> DataFrame:
        return self._table("postings", POSTINGS)

    def term_dict(self) -> DataFrame:
        return self._table("term_dict", TERM_DICT)

    def documents(self) -> DataFrame:
        stored = ", ".join(f"`{n}`: string" for n in self.schema.stored_fields) or "_: string"
        return self._table("docs", f"segment_id long, doc_id int, external_id string, doc_length int, field_lengths array<int>, stored struct<{stored}>")

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.store.deletes(self.manifest), ["segment_id", "doc_id"], "left_anti") if self.manifest.delete_versions else rows

    # dictionary
    def lookup(self, term: str) -> DataFrame:
        """segment_id, term, doc_freq; no row where the term isn't known."""
        return self.term_dict().where(F.col("term") == term)

    def prefix_range(self, prefix: str, limit: int | None = None) -> DataFrame:
        """term and doc_freq (over all segments) of the terms with a prefix, in byte order; all terms for the empty one."""
        found = self.term_dict().where(F.startswith("term", F.lit(prefix))).groupBy("term").agg(F.sum("doc_freq").alias("doc_freq")).orderBy("term")
        return found if limit is None else found.limit(limit)

    def term_count(self) -> int:
        return self.term_dict().select("term").distinct().count()

    def advance_to(self, term: str, target: int, *, segment_id: int):
        """The first posting of a term at or after a document, or None."""
        found = self.postings().where((F.col("segment_id") == segment_id) & (F.col("term") == term) & (F.col("doc_id") >= target))
        return found.agg(F.min_by(F.struct("doc_id", "tf"), "doc_id").alias("p")).first().p

    def posting_deltas(self, terms: list[str] | None = None) -> DataFrame:
        """segment_id, term, doc_id, delta: the distance from the term's posting before, of the first from 0; of all terms or some."""
        rows = self.postings() if terms is None else self.postings().where(F.col("term").isin(terms))
        before = F.lag("doc_id").over(Window.partitionBy("segment_id", "term").orderBy("doc_id"))
        return rows.select("segment_id", "term", "doc_id", (F.col("doc_id") - F.coalesce(before, F.lit(0))).alias("delta"))

    def posting_blocks(self, terms: list[str] | None = None, *, size: int = BLOCK) -> DataFrame:
        """segment_id, term, block, n, first_doc, last_doc: each term's postings in blocks of ``size``."""
        rows = self.postings() if terms is None else self.postings().where(F.col("term").isin(terms))
        place = F.row_number().over(Window.partitionBy("segment_id", "term").orderBy("doc_id")) - 1
        rows = rows.select("segment_id", "term", "doc_id", F.floor(place / size).alias("block"))
        return rows.groupBy("segment_id", "term", "block").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))

    # search
    def scores(self, queries: dict[int, Query]) -> DataFrame:
        """query_id, segment_id, doc_id, score of all matches of several queries: one scan and one sum by key.

        Only postings of the queries' terms are read. Every query's terms are few; they are matched by a literal list and a
        broadcast table of a row a term and query.
        """
        wanted = [(i, t) for i, q in queries.items() for t in q.terms()]
        none = empty(self.spark, "query_id int, segment_id long, doc_id int, score double")
        if not wanted or not self.manifest.segments:
            return none
        terms = sorted({t for _, t in wanted})
        df = self.term_dict().where(F.col("term").isin(terms))
        if self.df_scope == "global":
            df = df.groupBy("term").agg(F.sum("doc_freq").alias("doc_freq"))
        keys = ["term"] if self.df_scope == "global" else ["segment_id", "term"]
        hits = self._alive(self.postings().where(F.col("term").isin(terms))).join(F.broadcast(df), keys)
        score = self.scorer(F.col("tf"), F.col("doc_freq"), F.col("doc_length"), F.lit(float(self.manifest.total_docs)), F.lit(float(self.manifest.avgdl)))
        hits = hits.withColumn("s", score.cast("float" if self.exact_float else "double"))
        one = lambda t: F.max(F.when(F.col("term") == t, F.col("s")))
        per_doc = hits.groupBy("segment_id", "doc_id").agg(*[one(t).alias(f"t{k}") for k, t in enumerate(terms)])
        at = {t: F.col(f"t{k}") for k, t in enumerate(terms)}
        per_query = [F.struct(F.lit(i).alias("query_id"), q.compile(at, exact_float=self.exact_float).cast("double").alias("score")) for i, q in queries.items()]
        return per_doc.select("segment_id", "doc_id", F.inline(F.array(*per_query))).where("score is not null").select("query_id", "segment_id", "doc_id", "score")

    def matches(self, query: Query) -> DataFrame:
        """segment_id, doc_id, score of every match."""
        return self.scores({0: query}).drop("query_id")

    def top(self, query: Query, topk: int = 10, *, offset: int = 0) -> DataFrame:
        """external_id, score, segment_id, doc_id of the best matches; ties in the order of segments and documents."""
        best = self.matches(query).orderBy(F.desc("score"), "segment_id", "doc_id").offset(offset).limit(topk)
        names = self._table("docs", "segment_id long, doc_id int, external_id string")
        best, names = self._few(best, topk, names)
        kind = "float" if self.exact_float else "double"
        return names.join(best, ["segment_id", "doc_id"]).select("external_id", F.col("score").cast(kind).alias("score"), "segment_id", "doc_id").orderBy(F.desc("score"), "segment_id", "doc_id")

    def _few(self, hits: DataFrame, most: int, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Hits as a broadcast side, and of the documents those that may be theirs: the ids of few hits reach the scan as literals, where statistics prune by them."""
        if most > MOST_LITERALS:
            return hits, docs
        rows = hits.collect()  # at most ``most``
        docs = docs.where(F.col("segment_id").isin(sorted({r.segment_id for r in rows})) & F.col("doc_id").isin(sorted({r.doc_id for r in rows})))
        return F.broadcast(self.spark.createDataFrame(rows, hits.schema)), docs

    def search(self, query: Query, topk: int = 10, *, count_matches: bool = False) -> SearchResult:
        began = time.perf_counter()
        self.stats.queries.inc()
        docs = self.top(query, topk).collect() if self.manifest.segments and topk > 0 else []  # at most topk rows
        matches = self.matches(query).count() if count_matches else None
        took = int((time.perf_counter() - began) * 1e6)
        self.stats.latency_us.record(took)
        return SearchResult(docs, len(docs), matches, took)

    def search_with_stored(self, query: Query, topk: int = 10, *, offset: int = 0) -> DataFrame:
        """The best matches with their stored fields."""
        hits = self.matches(query).orderBy(F.desc("score"), "segment_id", "doc_id").offset(offset).limit(topk)
        hits, docs = self._few(hits, topk, self.documents().select("segment_id", "doc_id", "external_id", "stored"))
        hits = hits.withColumn("score", F.col("score").cast("float" if self.exact_float else "double"))
        return docs.join(hits, ["segment_id", "doc_id"]).select("external_id", "score", "segment_id", "doc_id", *[F.col("stored")[n].alias(n) for n in self.schema.stored_fields if n not in ("external_id", "score", "segment_id", "doc_id")]).orderBy(F.desc("score"), "segment_id", "doc_id")

    # documents
    def get_document(self, external_id: str) -> dict[str, str] | None:
        """The stored fields, in the schema's order, of the live document of that id; None if there is none."""
        if not external_id or not self.manifest.segments:
            return None
        found = self._alive(self.documents().where(F.col("external_id") == external_id)).orderBy("segment_id", "doc_id").limit(1).collect()
        return {n: found[0].stored[n] for n in self.schema.stored_fields} if found else None

    def find_doc_id(self, external_id: str) -> tuple[int, int] | None:
        """(segment_id, doc_id), or None."""
        found = self.documents().where(F.col("external_id") == external_id).orderBy("segment_id").select("segment_id", "doc_id").limit(1).collect()
        return tuple(found[0]) if found else None

    def resolve(self, hits: DataFrame, *, missing: str | None = None) -> DataFrame:
        """A frame with segment_id and doc_id, and their external_id; unknown ones get ``missing``, or else their number."""
        names = self._table("docs", "segment_id long, doc_id int, external_id string")
        other = F.col("doc_id").cast("string") if missing is None else F.lit(missing)
        return hits.join(names, ["segment_id", "doc_id"], "left").withColumn("external_id", F.coalesce("external_id", other))

    def doc_length(self, segment_id: int, doc_id: int) -> int:
        """0 for a document that isn't there."""
        found = self.documents().where((F.col("segment_id") == segment_id) & (F.col("doc_id") == doc_id)).select("doc_length").first()
        return found.doc_length if found else 0
