"""Searching and the life of an index."""

import json
import math

import pytest

from skerry.operators.reader import IndexReader
from skerry.operators.search_api import Engine, search_page
from skerry.operators.writer import IndexWriter, IndexWriterOptions
from skerry.plans.query import Query, build_query
from skerry.sources.json_docs import import_json
from skerry.sources.schema import CorruptIndexError, FieldType, InvalidArgumentError, Schema

T, AND, OR, NOT = Query.Term, Query.And, Query.Or, Query.Not


def writer(spark, path, schema=None, id_field="id", **options):
    return IndexWriter(spark, IndexWriterOptions(str(path), schema or Schema().text("text", stored=True).keyword("id"), id_field, **options))


def ids(result):
    return [d.external_id for d in result.docs]


def rows(spark, *texts, first=1, names="id string, text string"):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts, first)], names)


BASIC = [
    ("1", "quarry search engine", "A fast inverted index written in C++", "tech"),
    ("2", "Python programming", "Modern Python features and best practices", "tech"),
    ("3", "Machine learning basics", "Introduction to neural networks", "ml"),
    ("4", "Deep learning with CNN", "Convolutional neural networks for vision", "ml"),
    ("5", "Healthy recipes", "Delicious and nutritious meals", "lifestyle"),
    ("6", "Learning the guitar", "Beginner guide to playing guitar", "lifestyle"),
]
BASIC_SCHEMA = "doc_id string, title string, content string, category string"


def basic_schema():
    return Schema().text("title", stored=True).text("content").keyword("doc_id").keyword("category")


@pytest.fixture(scope="module")
def one(spark, tmp_path_factory):
    w = writer(spark, tmp_path_factory.mktemp("one"), basic_schema(), "doc_id")
    w.add_documents(spark.createDataFrame(BASIC, BASIC_SCHEMA))
    w.flush()
    return w


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    w = writer(spark, tmp_path_factory.mktemp("two"), basic_schema(), "doc_id")
    for part in (BASIC[:3], BASIC[3:]):
        w.add_documents(spark.createDataFrame(part, BASIC_SCHEMA))
        w.flush()
    return w


@pytest.mark.parametrize(
    ("query", "one_segment", "two_segments"),
    [
        (T("python"), {"2": 2.118112}, {"2": 2.118112}),
        (T("Python"), {}, {}),
        (T(""), {}, {}),
        (AND(T("neural"), T("networks")), {"3": 2.170216, "4": 1.95906}, {"3": 3.246926, "4": 2.931009}),
        (OR(T("search"), T("learning")), {"1": 1.397517, "3": 0.730502, "6": 0.693147, "4": 0.659427}, {"3": 1.623463, "1": 1.397517, "6": 1.029619, "4": 0.97953}),
        (NOT(T("learning"), T("neural")), {"6": 0.693147}, {"6": 1.029619}),
        (AND(OR(T("learning"), T("search")), T("guide")), {"6": 2.233592}, {"6": 2.570065}),
        (NOT(T("learning")), {}, {}),
        (AND(), {}, {}),
        (OR(), {}, {}),
        (OR(T("guide")), {"6": 1.540445}, None),
    ],
)
def test_scores(one, two, query, one_segment, two_segments):
    for w, expected in ((one, one_segment), (two, two_segments)):
        if expected is None:
            continue
        got = w.get_reader().search(query)
        assert ids(got) == sorted(expected, key=lambda k: -expected[k])
        for d in got.docs:
            assert math.isclose(d.score, expected[d.external_id], abs_tol=1e-5)
        assert got.total_hits == len(expected)


def test_same_child_twice_doubles(one):
    r = one.get_reader()
    assert math.isclose(r.search(AND(T("python"), T("python"))).docs[0].score, 2 * r.search(T("python")).docs[0].score, rel_tol=1e-6)


def test_ties_and_topk(spark, tmp_path):
    w = writer(spark, tmp_path)
    w.add_documents(rows(spark, "hello world", "hello everyone", "world peace"))
    w.flush()
    r = w.get_reader()
    got = r.search(OR(T("hello"), T("world")))
    assert ids(got) == ["1", "2", "3"]
    assert all(math.isclose(d.score, 0.470004, abs_tol=1e-5) for d in got.docs)
    assert ids(r.search(OR(T("hello"), T("world")), 2)) == ["1", "2"]
    assert r.search(OR(T("hello"), T("world")), 2, count_matches=True).total_matches == 3
    assert r.top(OR(T("hello"), T("world")), 2, offset=1).count() == 2
    assert r.stats.queries.get() >= 3


def test_or_is_the_best_child(spark, tmp_path):
    w = writer(spark, tmp_path)
    w.add_documents(rows(spark, "apple banana cherry", "apple banana", "cherry", "nothing"))
    w.flush()
    r = w.get_reader()
    got = r.search(OR(T("apple"), T("banana"), T("cherry")))
    assert [(d.external_id, round(d.score, 5)) for d in got.docs] == [("3", 0.84051), ("2", 0.65487), ("1", 0.5364)] or ids(got) == ["3", "2", "1"]
    assert ids(r.search(AND(T("apple"), OR(T("banana"), T("cherry"))))) == ["2", "1"]


def test_stored_fields_only(one):
    r = one.get_reader()
    assert r.get_document("2") == {"title": "Python programming", "doc_id": "2", "category": "tech"}
    assert r.get_document("nope") is None and r.get_document("") is None


def test_validation(spark, tmp_path):
    with pytest.raises(InvalidArgumentError):
        writer(spark, "")
    with pytest.raises(InvalidArgumentError):
        writer(spark, tmp_path / "x", Schema().add_field("a", FieldType.KEYWORD, indexed=True))
    with pytest.raises(InvalidArgumentError):
        Schema().text("a").keyword("a")
    w = writer(spark, tmp_path / "y")
    for bad in ([(None, "a")], [("", "a")], [("1", "a"), ("1", "b")]):
        with pytest.raises(InvalidArgumentError):
            w.add_documents(spark.createDataFrame(bad, "id string, text string"))
    w.add_documents(rows(spark, "first"))
    with pytest.raises(InvalidArgumentError):  # pending
        w.add_documents(rows(spark, "again"))
    w.flush()
    with pytest.raises(InvalidArgumentError):  # flushed
        w.add_documents(rows(spark, "again"))
    rejected = w.add_documents(rows(spark, "again", "new"), on_invalid="reject")
    assert [tuple(r) for r in rejected.collect()] == [("1", "taken external id")]
    w.flush()
    assert ids(w.get_reader().search(T("new"))) == ["2"]
    assert w.flush() == []


def test_snapshots_deletes_and_readd(spark, tmp_path):
    w = writer(spark, tmp_path)
    w.add_documents(rows(spark, "alpha beta", "alpha"))
    w.flush()
    before = w.get_reader()
    w.remove_document("1")
    w.remove_document("unknown")
    assert ids(before.search(T("alpha"))) == ["2", "1"]
    after = w.get_reader()
    assert ids(after.search(T("alpha"))) == ["2"] and after.get_document("1") is None
    w.add_documents(rows(spark, "alpha gamma"))
    w.flush()
    assert ids(w.get_reader().search(T("gamma"))) == ["1"]
    assert sorted(ids(w.get_reader().search(T("alpha")))) == ["1", "2"]
    stats = w.index_stats()
    assert (stats.docs_added.get(), stats.docs_removed.get(), stats.flushes.get(), stats.segment_count, stats.deleted_docs) == (3, 2, 2, 2, 1)
    quiet = writer(spark, tmp_path / "noop", remove_is_noop=True)
    quiet.add_documents(rows(spark, "alpha"))
    quiet.flush()
    quiet.remove_document("1")
    assert ids(quiet.get_reader().search(T("alpha"))) == ["1"]


def test_merge(spark, tmp_path):
    schema = Schema().keyword("id").text("title", stored=True).text("content")
    w = writer(spark, tmp_path, schema)
    texts = [("1", "Apple pie recipe", "Best apple pie content"), ("2", "Apple juice", "Fresh apple juice"), ("3", "Banana bread", "Easy banana bread"), ("4", "Banana smoothie", "Healthy banana smoothie")]
    for part in (texts[:2], texts[2:]):
        w.add_documents(spark.createDataFrame(part, "id string, title string, content string"))
        w.flush()
    old = w.get_reader()
    queries = [T("apple"), T("banana"), AND(T("apple"), T("juice")), OR(T("apple"), T("banana"))]
    expected = [ids(old.search(q)) for q in queries]
    with pytest.raises(InvalidArgumentError):
        w.merge([])
    meta = w.merge([0, 1], new_id=100)
    assert (meta.segment_id, meta.doc_count, meta.avgdl) == (100, 4, 5.5)
    r = w.get_reader()
    assert [ids(r.search(q)) for q in queries] == expected
    assert [(d.external_id, round(d.score, 4)) for d in r.search(T("apple")).docs] == [("2", 0.9781), ("1", 0.8852)]
    assert {x.term: x.doc_freq for x in r.term_dict().collect() if x.term in ("apple", "bread")} == {"apple": 2, "bread": 1}
    assert [x.external_id for x in r.documents().orderBy("doc_id").collect()] == ["1", "2", "3", "4"]
    assert w.vacuum() == [0, 1]
    w.remove_document("2")
    assert w.merge([100]).doc_count == 3
    assert [(x.doc_id, x.external_id) for x in w.get_reader().documents().orderBy("doc_id").collect()] == [(0, "1"), (1, "3"), (2, "4")]
    assert ids(w.get_reader().search(T("apple"))) == ["1"]
    w.remove_segments(w.manifest.ids)
    assert w.get_reader().search(T("apple")).total_hits == 0


def test_not_across_segments(spark, tmp_path):
    w = writer(spark, tmp_path)
    for k, texts in enumerate((["foo bar", "foo"], ["foo", "foo bar"])):
        w.add_documents(rows(spark, *texts, first=1 + 2 * k))
        w.flush()
    assert sorted(ids(w.get_reader().search(NOT(T("foo"), T("bar"))))) == ["2", "3"]


def test_many_segments_of_one_flush(spark, tmp_path):
    w = writer(spark, tmp_path, max_docs_per_segment=10)
    w.add_documents(rows(spark, *[f"repeating term in doc {i}" for i in range(50)]))
    assert w.pending_postings() == 250
    assert len(w.flush()) == 5
    r = w.get_reader(df_scope="global")
    assert r.search(T("repeating"), 100).total_hits == 50
    assert r.documents().groupBy("segment_id").agg({"doc_id": "max", "*": "count"}).where("`max(doc_id)` + 1 != `count(1)`").isEmpty()


def test_log_and_recovery(spark, tmp_path):
    w = writer(spark, tmp_path)
    w.add_documents(rows(spark, "kept", "gone"))
    w.remove_documents(spark.createDataFrame([("2",)], "id string"))
    state = w.wal.recover()
    assert {r.external_id for r in state.active_docs.collect()} == {"1", "2"}
    assert [r.external_id for r in state.removed_ids.collect()] == ["2"]
    assert {(r.external_id, r.op) for r in w.wal.replay().collect()} == {("1", "ADD"), ("2", "REMOVE")}
    assert w.wal.bytes_written() > 0
    again = writer(spark, tmp_path)  # opened after a crash: what was logged is pending
    again.flush()
    assert ids(again.get_reader().search(T("kept"))) == ["1"]
    assert again.get_reader().search(T("gone")).total_hits == 0
    assert again.wal.recover().next_internal_id == 0
    with pytest.raises(CorruptIndexError):
        IndexReader(spark, str(tmp_path), version=99)


def test_multi_valued_fields(spark, tmp_path):
    w = writer(spark, tmp_path)
    w.add_documents(spark.createDataFrame([("1", ["red fox", "blue fox"]), ("2", None)], "id string, text array<string>"))
    w.flush()
    r = w.get_reader()
    assert r.get_document("1")["text"] == "red fox" and r.get_document("2")["text"] == ""
    got = r.postings().where("term = 'fox'").collect()
    assert [(p.doc_id, p.tf, p.doc_length) for p in got] == [(0, 2, 4)]
    assert r.doc_length(0, 1) == 0 and r.doc_length(5, 5) == 0


def test_dictionary(one):
    r = one.get_reader()
    assert [x.term for x in r.prefix_range("ne").collect()] == ["networks", "neural"]
    assert r.prefix_range("", 3).count() == 3
    assert r.lookup("neural").first().doc_freq == 2 and r.lookup("neur").isEmpty()
    assert r.term_count() == r.prefix_range("").count()
    assert r.advance_to("learning", 3, segment_id=0).doc_id == 3 and r.advance_to("learning", 6, segment_id=0) is None
    assert r.find_doc_id("3") == (0, 2) and r.find_doc_id("x") is None


def test_cjk_search_and_box(spark, tmp_path):
    w = writer(spark, tmp_path, Schema().text("title", stored=True).text("content").keyword("doc_id").keyword("url"), "doc_id")
    engine = Engine(w)
    assert engine.add('{"title": "我爱北京", "content": "天安门", "url": "u"}') == {"doc_id": "1000"}
    engine.add({"title": "Hello", "content": "plain text"})
    with pytest.raises(InvalidArgumentError):
        engine.add({"url": "x"})
    assert build_query("我爱北京") == AND(T("我爱"), T("爱北"), T("北京")) and build_query("京") == T("京") and build_query("hello World") == T("hello World")
    page = engine.search("北京")
    assert page["total_hits"] == 1 and page["results"][0]["title"] == "我爱北京" and page["results"][0]["url"] == "u"
    assert engine.search("hello", 2)["results"] == [] and search_page(engine.reader, "hello", -3)["page"] == 1
    assert engine.document("1001")["title"] == "Hello" and engine.document("7") is None


def test_json_import(spark, tmp_path):
    docs = [{"title": "A", "content": "x \"quoted\" } text"}, {"title": "", "content": ""}, {"content": "only", "category": "c"}, {"url": "none"}]
    (tmp_path / "d.json").write_text(json.dumps(docs))
    got = import_json(spark, str(tmp_path / "d.json")).collect()
    assert [(r.doc_id, r.title, r.category, r.content) for r in got] == [("10000", "A", "General", 'x "quoted" } text'), ("10001", "Untitled", "c", "only")]


def test_stream(spark, tmp_path):
    from skerry.streaming.ingest import index_stream

    w = writer(spark, tmp_path / "index")
    rejected = []
    for k, texts in enumerate((["one stream", "two stream"], ["three stream", "again"])):
        rows(spark, *texts, first=1 + k).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string, text string").parquet(str(tmp_path / "in"))
        index_stream(stream, w, str(tmp_path / "cp"), on_rejected=lambda bad, _: rejected.extend(bad.collect())).awaitTermination(120)
    assert sorted(ids(w.get_reader().search(T("stream")))) == ["1", "2"]
    assert ids(w.get_reader().search(T("again"))) == ["3"]
    assert [r.external_id for r in rejected] == ["2"] and len(w.manifest.batches) == 2


@pytest.mark.parametrize("step", ["_write_postings", "_metas", "_publish"])
def test_a_flush_that_failed_can_be_run_again(spark, tmp_path, step):
    w = writer(spark, tmp_path)
    w.add_documents(rows(spark, "alpha beta beta", "alpha"))
    real = getattr(w, step)

    def broken(*args):
        if step != "_publish":
            real(*args)
        raise InterruptedError

    setattr(w, step, broken)
    with pytest.raises(InterruptedError):
        w.flush()
    again = writer(spark, tmp_path)
    again.flush()
    r = again.get_reader()
    assert ids(r.search(T("alpha"))) == ["2", "1"] and r.documents().count() == 2
    assert sorted((p.term, p.doc_id, p.tf) for p in r.postings().collect()) == [("alpha", 0, 1), ("alpha", 1, 1), ("beta", 0, 2)]
    assert sorted((t.term, t.doc_freq) for t in r.term_dict().collect()) == [("alpha", 2), ("beta", 1)]


def test_used_ids_rejected_rows_and_reclaimed_deletes(spark, tmp_path):
    with writer(spark, tmp_path) as w:
        w.add_documents(rows(spark, "a", "b", "c"))
    rejected = w.add_documents(rows(spark, "again", "new", first=3), on_invalid="reject")
    w.flush()
    assert [tuple(r) for r in rejected.collect()] == [("3", "taken external id")]  # after the log is gone
    with pytest.raises(InvalidArgumentError):
        w.merge([0, 1], new_id=1)
    w.remove_document("1")
    w.remove_document("4")
    assert len(w.manifest.delete_versions) == 2
    w.merge([0])
    assert len(w.manifest.delete_versions) == 1 and ids(w.get_reader().search(T("new"))) == []
    w.merge(w.manifest.ids)
    assert w.manifest.delete_versions == () and sorted(d.external_id for d in w.get_reader().documents().collect()) == ["2", "3"]
    w.vacuum()
    assert w.store.names("deletes") == []


def test_insertion_order_is_kept(spark, tmp_path):
    w = writer(spark, tmp_path)
    order = [str(k * 37 % 100) for k in range(100)]
    w.add_documents(spark.createDataFrame([(i, "same") for i in order], "id string, text string").coalesce(1))
    w.remove_document(order[5])
    w.flush()
    got = [r.external_id for r in w.get_reader().documents().orderBy("doc_id").collect()]
    assert got == order[:5] + order[6:]


def test_deltas_and_blocks(one):
    r = one.get_reader()
    assert [tuple(x)[2:] for x in r.posting_deltas(["learning"]).orderBy("doc_id").collect()] == [(2, 2), (3, 1), (5, 2)]
    assert [tuple(x)[2:] for x in r.posting_blocks(["learning"], size=2).orderBy("block").collect()] == [(0, 2, 2, 3), (1, 1, 5, 5)]


def test_own_scorer_missing_names_and_schema_lookups(one):
    from pyspark.sql import functions as F

    r = IndexReader(one.spark, one.options.index_dir, scorer=lambda tf, df, dl, n, avgdl: tf * F.lit(1.0))
    assert [(d.external_id, d.score) for d in r.search(T("guitar")).docs] == [("6", 2.0)]
    hits = one.spark.createDataFrame([(0, 1), (0, 99)], "segment_id long, doc_id int")
    assert sorted(x.external_id for x in r.resolve(hits, missing="?").collect()) == ["2", "?"]
    assert sorted(x.external_id for x in r.resolve(hits).collect()) == ["2", "99"]


def test_http_server(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request

    from skerry.operators.search_api import serve

    w = writer(spark, tmp_path, Schema().text("title", stored=True).text("content").keyword("doc_id"), "doc_id")
    server = serve(Engine(w), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda url, data=None: json.loads(urllib.request.urlopen(urllib.request.Request(base + url, data=data)).read())
    try:
        assert get("/api/document", b'{"title": "Hello", "content": "plain words"}') == {"doc_id": "1000"}
        assert get("/api/search?q=hello")["results"][0]["doc_id"] == "1000"
        assert get("/api/document/1000")["title"] == "Hello"
        for url, data, code in (("/api/document/7", None, 404), ("/x", None, 404), ("/api/document", b"{}", 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                get(url, data)
            assert e.value.code == code
    finally:
        server.shutdown()
