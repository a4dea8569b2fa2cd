"""The engine's registered queries over the driver's tables, and the SQL that gives the same rows.

Queries that search use an index of the table, built once a folder of tables and kept for the session. Scores are
doubles rounded to six digits on both sides, so that the order of sums doesn't matter.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analysis, scoring
from .operators.reader import IndexReader
from .operators.stats import histogram, percentile
from .operators.writer import IndexWriter, IndexWriterOptions
from .plans.query import Query, build_query
from .sources.schema import Schema
from .sources.wal import WriteAheadLog

T, AND, OR, NOT = Query.Term, Query.And, Query.Or, Query.Not
_kept: dict[tuple, IndexWriter] = {}


def _folder(spark: SparkSession, kind: str) -> str:
    """A folder for an index: in the warehouse where that is shared, in tests a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared or tempfile.mkdtemp(prefix='skerry-')}/{kind}-{uuid.uuid4().hex}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SCHEMAS = {
    "documents": (Schema().keyword("doc_id").text("text").keyword("lang").keyword("source"), "doc_id"),
    "part": (Schema().keyword("p_partkey").text("p_name", stored=True).text("p_type").keyword("p_brand"), "p_partkey"),
    "conversations": (Schema().keyword("id").text("text").keyword("role"), "id"),
    "pages": (Schema().keyword("page_id").text("html").keyword("url"), "page_id"),
}


def index(spark: SparkSession, sf_dir: str, table: str = "documents", parts: int = 1) -> IndexWriter:
    """A writer of the table's index; with ``parts`` the rows are dealt into as many flushes by id, one segment each.

    One segment's documents are numbered in the order of their ids, whatever files they come in (Spark reads the largest first).
    """
    key = (spark.sparkContext.applicationId, sf_dir, table, parts)
    if key not in _kept:
        schema, id_field = SCHEMAS[table]
        rows = _table(spark, sf_dir, table)
        if table == "conversations":
            rows = rows.withColumn("id", F.concat_ws("-", "conv_id", "turn"))
        writer = IndexWriter(spark, IndexWriterOptions(_folder(spark, table), schema, id_field))
        for k in range(parts):
            writer.add_documents(rows.where(F.col(id_field).cast("long") % parts == k) if parts > 1 else rows.orderBy(id_field))
            writer.flush()
        _kept[key] = writer
    return _kept[key]


def _reader(spark: SparkSession, sf_dir: str, table: str = "documents", parts: int = 1, **options) -> IndexReader:
    return index(spark, sf_dir, table, parts).get_reader(exact_float=False, **options)


def _named(reader: IndexReader, hits: DataFrame) -> DataFrame:
    """doc_id (the external id) and the rounded score."""
    return reader.resolve(hits).select(F.col("external_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


def _ids(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select(F.col("external_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), *more)


def _search(query: Query, parts: int = 1):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reader = _reader(spark, sf_dir, parts=parts)
        return _named(reader, reader.matches(query))

    return run


def term_topk(spark: SparkSession, sf_dir: str, k: int = 10, page: int = 1) -> DataFrame:
    return _ids(_reader(spark, sf_dir).top(T("that"), k, offset=(page - 1) * k))


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = _reader(spark, sf_dir)
    got = reader.scores({1: T("that"), 2: AND(T("that"), T("with")), 3: OR(T("les"), T("und"))})
    return reader.resolve(got).select("query_id", F.col("external_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


def search_with_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(_reader(spark, sf_dir).search_with_stored(T("that"), 10), "lang", "source")


def get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reader(spark, sf_dir).get_document("7")
    return spark.createDataFrame([found] if found else [], "doc_id string, lang string, source string")


def _term_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = _reader(spark, sf_dir)
    return reader.resolve(reader.postings()).select(F.col("external_id").cast("long").alias("doc_id"), "term", "tf", "doc_length")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_rows(spark, sf_dir).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


def term_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir, parts=4).term_dict().select("segment_id", "term", F.col("doc_freq").cast("long").alias("doc_freq"))


def distinct_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir, parts=4).term_dict().select("term").distinct()


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).documents().select(F.col("external_id").cast("long").alias("doc_id"), F.col("doc_length").cast("long").alias("doc_length"))


def segment_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _reader(spark, sf_dir, parts=4).documents()
    return docs.groupBy("segment_id").agg(F.count("*").alias("doc_count"), F.sum("doc_length").alias("total_terms"), F.round(F.sum("doc_length") / F.count("*"), 6).alias("avgdl"))


def field_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _reader(spark, sf_dir, "part").documents()
    return docs.select(F.col("external_id").cast("long").alias("p_partkey"), F.get("field_lengths", F.lit(0)).cast("long").alias("name_length"), F.get("field_lengths", F.lit(1)).cast("long").alias("type_length"))


def prefix_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).prefix_range("th", 100).select("term", F.col("doc_freq").cast("long").alias("doc_freq"))


def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).lookup("that").select("term", F.col("doc_freq").cast("long").alias("doc_freq"))


def stopword_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stop = analysis.Analyzer(filters=(analysis.keep_all, analysis.stopword_filter(["the", "of", "and", "les", "der"])))
    return stop.analyze(_table(spark, sf_dir, "documents"), "text", "doc_id").groupBy("doc_id").agg(F.sum("tf").cast("long").alias("n_tokens"), F.count("*").alias("n_terms"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(analysis.normalize(F.col("text"))).alias("text_md5"))


def standard_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = analysis.term_counts(_table(spark, sf_dir, "documents"), analysis.standard_tokens(F.col("text")), "doc_id")
    return counts.select("doc_id", F.col("term").alias("token"), F.col("tf").cast("long").alias("n"))


def token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(analysis.standard_tokens(analysis.normalize(F.col("text")))).alias("position", "token"))


# Texts that hold what the tables lack.
CJK_TEXTS = ((1, "我爱北京"), (2, "Hello世界"), (3, "我 a 爱b北京"), (4, "中"), (5, "hello world test"), (6, "全文 search 引擎"), (7, "かな漢字カナ"))


def _cjk(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CJK_TEXTS), "id int, text string")


def cjk_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cjk(spark).select("id", F.explode(analysis.cjk_bigrams(F.col("text"))).alias("token"))


def mixed_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cjk(spark).select("id", F.explode(analysis.mixed_tokens(F.col("text"))).alias("token"))


def deleted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, "deleted")
    if key not in _kept:
        schema, id_field = SCHEMAS["documents"]
        writer = IndexWriter(spark, IndexWriterOptions(_folder(spark, "deleted"), schema, id_field))
        writer.add_documents(_table(spark, sf_dir, "documents"))
        writer.flush()
        writer.remove_documents(_table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct())
        _kept[key] = writer
    reader = _kept[key].get_reader(exact_float=False)
    return _named(reader, reader.matches(OR(T("that"), T("les"))))


def _merged(spark: SparkSession, sf_dir: str) -> IndexWriter:
    key = (spark.sparkContext.applicationId, sf_dir, "merged")
    if key not in _kept:
        own = index(spark, sf_dir, parts=4)
        writer = IndexWriter(spark, own.options)
        writer.merge([0, 1, 2, 3], new_id=1000, publish=False)
        _kept[key] = writer
    return _kept[key]


def merged_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    writer = _merged(spark, sf_dir)
    rows = writer.store.table("term_dict", [1000], "segment_id long, term string, doc_freq int")
    return rows.select("segment_id", "term", F.col("doc_freq").cast("long").alias("doc_freq"))


def merged_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _merged(spark, sf_dir).store.table("docs", [1000], "segment_id long, doc_id int, doc_length int")
    return docs.groupBy("segment_id").agg(F.count("*").alias("doc_count"), F.sum("doc_length").alias("total_terms"), F.max("doc_id").cast("long").alias("last_doc"))


def dedup_external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in their order as documents of their user: the first of each is taken, the others are rejected."""
    writer = IndexWriter(spark, IndexWriterOptions(_folder(spark, "events"), Schema().keyword("user_id").keyword("event_id").text("event_type"), "user_id"))
    writer.add_documents(_table(spark, sf_dir, "events").orderBy("event_id"), on_invalid="reject")
    docs = writer.refresh_reader().documents()
    return docs.select(F.col("external_id").cast("long").alias("external_id"), F.col("stored.event_id").cast("long").alias("event_id"))


def wal_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in order of time as operations of their user, logged and replayed."""
    log = WriteAheadLog(spark, _folder(spark, "log"))
    op = F.when(F.col("event_type") == "purchase", "ADD").otherwise("REMOVE").alias("op")
    fields = F.array(F.struct(F.lit("event_type").alias("name"), F.col("event_type").alias("value"))).alias("fields")
    log.append(_table(spark, sf_dir, "events").orderBy("ts", "event_id").select(op, F.col("event_id").alias("internal_id"), F.col("user_id").alias("external_id"), fields))
    return log.replay().select(F.col("external_id").cast("long").alias("user_id"), F.col("internal_id").alias("event_id"), "op")


BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(_table(spark, sf_dir, "events"), "value", BOUNDS).select("bucket", "upper", "n", "cumulative")


def histogram_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentile(_table(spark, sf_dir, "events"), "value", BOUNDS, 95.0)


def advance_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of three terms' first posting at or after the document of id 100."""
    reader = _reader(spark, sf_dir)
    at = reader.find_doc_id("100")
    found = [(t, p.doc_id) for t in ("that", "les", "und") if at and (p := reader.advance_to(t, at[1], segment_id=at[0]))]
    hits = spark.createDataFrame([(at[0], d, t) for t, d in found], "segment_id long, doc_id int, term string")
    return reader.resolve(hits).select("term", F.col("external_id").cast("long").alias("doc_id"))


def posting_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).posting_deltas().select("term", F.col("doc_id").cast("long").alias("doc"), F.col("delta").cast("long").alias("delta"))


def posting_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).posting_blocks().select("term", "block", "n", F.col("first_doc").cast("long").alias("first_doc"), F.col("last_doc").cast("long").alias("last_doc"))


def retry_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings by document after a flush that failed once everything but the manifest was written, and was run again."""
    schema, id_field = SCHEMAS["documents"]
    writer = IndexWriter(spark, IndexWriterOptions(_folder(spark, "retry"), schema, id_field))
    writer.add_documents(_table(spark, sf_dir, "documents"))
    writer._publish = _fail
    try:
        writer.flush()
    except InterruptedError:
        pass
    reader = IndexWriter(spark, writer.options).refresh_reader()
    rows = reader.resolve(reader.postings().groupBy("segment_id", "doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens")))
    return rows.groupBy(F.col("external_id").cast("long").alias("doc_id")).agg(F.sum("n_terms").alias("n_terms"), F.sum("n_tokens").alias("n_tokens"))


def _fail(*_) -> None:
    raise InterruptedError("before the manifest")


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = _reader(spark, sf_dir)
    return reader.term_dict().select("term", F.round(scoring.idf(F.col("doc_freq"), F.lit(float(reader.manifest.total_docs))), 6).alias("idf"))


def combine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = _reader(spark, sf_dir)
    idf = scoring.idf(F.col("doc_freq"), F.lit(float(reader.manifest.total_docs)))
    rows = _term_rows(spark, sf_dir).where("term in ('that', 'with', 'les', 'und')").join(F.broadcast(reader.term_dict().where("term in ('that', 'with', 'les', 'und')").select("term", "doc_freq")), "term")
    return rows.groupBy("doc_id").agg(F.round(scoring.combine(F.collect_list(idf)), 6).alias("score"))


def part_multifield_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = _reader(spark, sf_dir, "part")
    return term.resolve(term.matches(OR(T("red"), T("economy")))).select(F.col("external_id").cast("long").alias("p_partkey"), F.round("score", 6).alias("score"))


def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = _reader(spark, sf_dir, "conversations")
    return reader.resolve(reader.matches(OR(T("the"), T("of")))).select(F.col("external_id").alias("id"), F.round("score", 6).alias("score"))


def html_page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = _reader(spark, sf_dir, "pages")
    return reader.resolve(reader.matches(AND(T("article"), T("with")))).select(F.col("external_id").cast("long").alias("page_id"), F.round("score", 6).alias("score"))


def query_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = _reader(spark, sf_dir)
    return _named(reader, reader.matches(build_query("that")))


NESTED = NOT(AND(OR(T("that"), T("les"), T("und")), T("with")), T("del"))

QUERIES = {
    "term_search": _search(T("that")),
    "term_topk": term_topk,
    "paged_search": lambda spark, sf_dir: term_topk(spark, sf_dir, page=2),
    "and_search": _search(AND(T("that"), T("with"))),
    "or_search": _search(OR(T("that"), T("les"))),
    "not_search": _search(NOT(T("that"), T("with"))),
    "nested_search": _search(NESTED),
    "unary_not_empty": _search(NOT(T("that"))),
    "missing_term": _search(T("nonexistent98765")),
    "uppercase_term": _search(T("That")),
    "multi_segment_term": _search(T("that"), 4),
    "multi_segment_not": _search(NOT(OR(T("that"), T("les")), T("with")), 4),
    "multi_segment_nested": _search(NESTED, 4),
    "batch_search": batch_search,
    "query_box": query_box,
    "search_with_stored": search_with_stored,
    "get_document": get_document,
    "postings": postings,
    "term_dict": term_dict,
    "distinct_terms": distinct_terms,
    "doc_lengths": doc_lengths,
    "field_lengths": field_lengths,
    "segment_meta": segment_meta,
    "prefix_range": prefix_range,
    "term_lookup": term_lookup,
    "stopword_postings": stopword_postings,
    "normalize_text": normalize_text,
    "standard_tokens": standard_tokens,
    "token_positions": token_positions,
    "cjk_bigrams": cjk_bigrams,
    "mixed_dispatch": mixed_dispatch,
    "deleted_search": deleted_search,
    "merged_postings": merged_postings,
    "merged_meta": merged_meta,
    "dedup_external_ids": dedup_external_ids,
    "wal_recover": wal_recover,
    "latency_histogram": latency_histogram,
    "histogram_percentile": histogram_percentile,
    "advance_to": advance_to,
    "retry_flush": retry_flush,
    "posting_deltas": posting_deltas,
    "posting_blocks": posting_blocks,
    "bm25_idf": bm25_idf,
    "combine_scores": combine_scores,
    "part_multifield_search": part_multifield_search,
    "conversation_search": conversation_search,
    "html_page_search": html_page_search,
}

# The same in SQL.
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"


def _tokens(text: str) -> str:
    return f"unnest(regexp_extract_all(translate({text},{_AZ}),'[0-9a-z]+'))"


def _with(table: str = "documents", key: str = "doc_id", text: str = "text", parts: int = 1, id_expr: str | None = None) -> str:
    """tok, post, dl, df, st and sc (doc_id, seg, term, s): the BM25 score of each term in each row."""
    own = id_expr or key
    texts = text.split("+")
    tok = " union all ".join(f"select {own} as doc_id, {f'{own} % {parts}' if parts > 1 else '0'} as seg, {_tokens(t)} as term from {table}" for t in texts)
    return f"""with tok as ({tok}),
post as (select seg, term, doc_id, count(*) as tf from tok group by all),
dl as (select doc_id, count(*) as dl from tok group by all),
df as (select seg, term, count(*) as df from post group by all),
ids as (select {own} as doc_id, {f'{own} % {parts}' if parts > 1 else '0'} as seg from {table}),
per as (select seg, count(*) as k, sum(coalesce(dl, 0)) as t from ids left join dl using (doc_id) group by seg),
st as (select sum(k)::double as n, sum(floor((t / k) * k)) / sum(k) as avgdl from per),
sc as (select doc_id, seg, term, ln((n-df+0.5)/(df+0.5)+1.0)*(tf*2.2)/(tf+1.2*(1-0.75+0.75*dl/avgdl)) as s from post join df using (seg, term) join dl using (doc_id), st)
"""


def _list(*terms: str) -> str:
    return ", ".join(f"'{t}'" for t in terms)


def _or(*terms: str) -> str:
    return f"select doc_id, max(s) as s from sc where term in ({_list(*terms)}) group by doc_id"


def _and(left: str, right: str) -> str:
    return f"select l.doc_id, l.s + r.s as s from ({left}) l join ({right}) r using (doc_id)"


def _not(left: str, right: str) -> str:
    return f"select doc_id, s from ({left}) where doc_id not in (select doc_id from ({right}))"


def _scores(sql: str, *, name: str = "doc_id", **source) -> str:
    return f"{_with(**source)}select doc_id as {name}, round(s, 6) as score from ({sql})"


_NESTED_SQL = _not(_and(_or("that", "les", "und"), _or("with")), _or("del"))
_TOPK = "select doc_id, round(s, 6) as score from sc where term = 'that' order by score desc, doc_id limit 10"
_EMPTY = "select 0::bigint as doc_id, 0.0::double as score where false"
_CJK_VALUES = ", ".join(f"({i}, '{t}')" for i, t in CJK_TEXTS)
_CJK_CHARS = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"
_CJK_SQL = f"""with t(id, text) as (values {_CJK_VALUES}),
c as (select id, text, unnest(range(1, length(text)::bigint + 1)) as pos from t),
k as (select id, text, pos, lead(pos) over (partition by id order by pos) as nxt from c where regexp_matches(substr(text, pos, 1), '{_CJK_CHARS}')),
big as (select id, substr(text, pos, nxt - pos + 1) as token from k where nxt is not null),
"""
_HIST = f"""with b(bucket, upper) as (values {", ".join(f"({k}, {b}::double)" for k, b in enumerate((*BOUNDS, BOUNDS[-1] * 2)))}),
h as (select {" + ".join(f"(value >= {b})::int" for b in BOUNDS)} as bucket, count(*) as n from events where value is not null group by 1),
a as (select bucket, upper, coalesce(n, 0)::bigint as n from b left join h using (bucket)),
hist as (select bucket, upper, n, (sum(n) over (order by bucket))::bigint as cumulative from a)
"""
_THREE = "term in ('that', 'les', 'und')"

ORACLE_SQL = {
    "term_search": _scores(_or("that")),
    "term_topk": f"{_with()}{_TOPK}",
    "paged_search": f"{_with()}{_TOPK} offset 10",
    "and_search": _scores(_and(_or("that"), _or("with"))),
    "or_search": _scores(_or("that", "les")),
    "not_search": _scores(_not(_or("that"), _or("with"))),
    "nested_search": _scores(_NESTED_SQL),
    "unary_not_empty": _EMPTY,
    "missing_term": _scores(_or("nonexistent98765")),
    "uppercase_term": _scores(_or("That")),
    "multi_segment_term": _scores(_or("that"), parts=4),
    "multi_segment_not": _scores(_not(_or("that", "les"), _or("with")), parts=4),
    "multi_segment_nested": _scores(_NESTED_SQL, parts=4),
    "batch_search": f"{_with()}select 1 as query_id, doc_id, round(s, 6) as score from ({_or('that')}) union all select 2, doc_id, round(s, 6) from ({_and(_or('that'), _or('with'))}) union all select 3, doc_id, round(s, 6) from ({_or('les', 'und')})",
    "query_box": _scores(_or("that")),
    "search_with_stored": f"{_with()}select b.doc_id, b.score, d.lang, d.source from ({_TOPK}) b join documents d using (doc_id)",
    "get_document": "select doc_id::varchar as doc_id, lang, source from documents where doc_id = 7",
    "postings": f"{_with()}select doc_id, term, tf from post",
    "term_dict": f"{_with(parts=4)}select seg::bigint as segment_id, term, df as doc_freq from df",
    "distinct_terms": f"{_with()}select distinct term from tok",
    "doc_lengths": f"{_with()}select doc_id, coalesce(dl, 0)::bigint as doc_length from ids left join dl using (doc_id)",
    "field_lengths": f"select p_partkey, len(regexp_extract_all(translate(p_name,{_AZ}),'[0-9a-z]+'))::bigint as name_length, len(regexp_extract_all(translate(p_type,{_AZ}),'[0-9a-z]+'))::bigint as type_length from part",
    "segment_meta": f"{_with(parts=4)}select seg::bigint as segment_id, k::bigint as doc_count, t::bigint as total_terms, round(t / k, 6) as avgdl from per",
    "prefix_range": f"{_with()}select term, sum(df)::bigint as doc_freq from df where starts_with(term, 'th') group by term order by term limit 100",
    "term_lookup": f"{_with()}select term, df as doc_freq from df where term = 'that'",
    "stopword_postings": f"{_with()}select doc_id, sum(tf)::bigint as n_tokens, count(*) as n_terms from post where term not in ('the', 'of', 'and', 'les', 'der') group by doc_id",
    "normalize_text": f"select doc_id, md5(translate(text,{_AZ})) as text_md5 from documents",
    "standard_tokens": "select doc_id, token, count(*) as n from (select doc_id, unnest(regexp_extract_all(text,'[0-9A-Za-z]+')) as token from documents) group by all",
    "token_positions": f"select item_id, (position - 1)::int as position, token from (select item_id, unnest(x) as token, generate_subscripts(x, 1) as position from (select item_id, regexp_extract_all(translate(text,{_AZ}),'[0-9a-z]+') as x from benchmark))",
    "cjk_bigrams": f"{_CJK_SQL}z as (select 1) select id, token from big",
    "mixed_dispatch": f"{_CJK_SQL}n as (select id, text, len(regexp_extract_all(text, '{_CJK_CHARS}')) * 2 > length(text) as cjk from t) select id, token from big join n using (id) where cjk union all select id, unnest(regexp_extract_all(text, '([0-9A-Za-z]|{_CJK_CHARS})+')) from n where not cjk",
    "deleted_search": _scores(f"select * from ({_or('that', 'les')}) where doc_id not in (select doc_id from labels where toxic = 1)"),
    "merged_postings": f"{_with()}select 1000::bigint as segment_id, term, sum(df)::bigint as doc_freq from df group by term",
    "merged_meta": f"{_with()}select 1000::bigint as segment_id, count(*) as doc_count, sum(coalesce(dl, 0))::bigint as total_terms, (count(*) - 1)::bigint as last_doc from ids left join dl using (doc_id)",
    "dedup_external_ids": "select user_id as external_id, min(event_id) as event_id from events group by user_id",
    "wal_recover": "select user_id, event_id, case when event_type = 'purchase' then 'ADD' else 'REMOVE' end as op from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1",
    "latency_histogram": f"{_HIST}select bucket, upper, n, cumulative from hist",
    "histogram_percentile": f"{_HIST}select coalesce(min(upper) filter (where cumulative >= ceil(0.95 * (select max(cumulative) from hist))), 0.0)::double as percentile from hist",
    "advance_to": f"{_with()}select term, min(doc_id) as doc_id from post where {_THREE} and doc_id >= 100 group by term",
    "retry_flush": f"{_with()}select doc_id, count(*) as n_terms, sum(tf)::bigint as n_tokens from post group by doc_id",
    "posting_deltas": f"{_with()}, numbered as (select doc_id, row_number() over (order by doc_id) - 1 as doc from ids) select term, doc, doc - coalesce(lag(doc) over (partition by term order by doc), 0) as delta from post join numbered using (doc_id)",
    "posting_blocks": f"{_with()}, numbered as (select doc_id, row_number() over (order by doc_id) - 1 as doc from ids), q as (select term, doc, (row_number() over (partition by term order by doc) - 1) // 128 as block from post join numbered using (doc_id)) select term, block::bigint as block, count(*) as n, min(doc) as first_doc, max(doc) as last_doc from q group by term, block",
    "bm25_idf": f"{_with()}select term, round(ln((n-df+0.5)/(df+0.5)+1.0), 6) as idf from df, st",
    "combine_scores": f"{_with()}select doc_id, round(sum(ln((n-df+0.5)/(df+0.5)+1.0)), 6) as score from post join df using (seg, term), st where term in ('that', 'with', 'les', 'und') group by doc_id",
    "part_multifield_search": _scores(_or("red", "economy"), name="p_partkey", table="part", key="p_partkey", text="p_name+p_type"),
    "conversation_search": _scores(_or("the", "of"), name="id", table="conversations", id_expr="concat_ws('-', conv_id, turn)"),
    "html_page_search": _scores(_and(_or("article"), _or("with")), name="page_id", table="pages", key="page_id", text="html"),
}
