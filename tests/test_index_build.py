"""How an index is built: the order of documents, and what is exchanged on the way."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from skerry import queries as core
from skerry.functions import analysis
from skerry.operators.writer import IndexWriter, IndexWriterOptions, postings_of
from skerry.sources.schema import InvalidArgumentError, Schema

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    """documents in two files, of which the second one is the larger: Spark reads it first."""
    path = tmp_path_factory.mktemp("uneven")
    os.mkdir(path / "documents.parquet")
    con = duckdb.connect()
    for k, where in enumerate(("doc_id < 40", "doc_id >= 40")):
        con.execute(f"copy (select * from '{SF}/documents.parquet' where {where} order by doc_id) to '{path}/documents.parquet/part-{k}.parquet'")
    return str(path)


@pytest.mark.parametrize("name", ["posting_blocks", "posting_deltas", "advance_to"])
def test_documents_are_numbered_by_id_whatever_file_is_read_first(spark, uneven, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{uneven}/documents.parquet/*.parquet'")
    rel = con.execute(core.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(map(tuple, core.QUERIES[name](spark, uneven).select(*names).collect())) == sorted(rel.fetchall())


TOKENS = [[], ["b", "a", "b"], ["x"], ["b", "b", "b", "é", "a", "é"], None]


def test_tokens_are_counted_in_their_row(spark):
    df = spark.createDataFrame(list(enumerate(TOKENS)), "k int, tokens array<string>")
    got = df.select("k", F.inline(analysis.counted(F.col("tokens"))))
    assert "Exchange" not in plan(got)
    found = Counter({(r.k, r.term): r.tf for r in got.collect()})
    assert found == Counter((k, t) for k, x in enumerate(TOKENS) for t in x or ())


def test_counts_of_rows_that_share_a_key_are_summed(spark):
    df = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "a"), (None, "a"), (None, "a")], "k int, text string")
    got = analysis.Analyzer().analyze(df, "text", "k")
    assert {(r.k, r.term): r.tf for r in got.collect()} == {(1, "a"): 2, (1, "b"): 2, (1, "c"): 1, (2, "a"): 1, (None, "a"): 2}
    assert dict(got.dtypes)["tf"] == "int"


@pytest.mark.parametrize("name", ["standard_tokens", "stopword_postings"])
def test_no_token_is_exchanged_where_ids_are_unique(spark, name):
    got = core.QUERIES[name](spark, SF)
    assert "hashpartitioning(doc_id#" not in plan(got) or name == "stopword_postings"
    assert ", term#" not in "".join(x for x in plan(got).splitlines() if "hashpartitioning" in x)


def test_postings_are_made_without_an_exchange(spark):
    docs = spark.createDataFrame([(0, 0, 3, ["a", "b", "a"])], "segment_id long, doc_id int, doc_length int, tokens array<string>")
    got = postings_of(docs.withColumn("terms", analysis.counted(F.col("tokens"))))
    assert "Exchange" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(0, "a", 0, 2, 3), (0, "b", 0, 1, 3)]


def test_a_batch_is_read_once_and_a_refused_one_leaves_no_trace(spark, tmp_path):
    writer = IndexWriter(spark, IndexWriterOptions(str(tmp_path), Schema().text("text", stored=True).keyword("id"), "id"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    batch = lambda *ids: spark.createDataFrame([(i, "a") for i in ids], "id string, text string").withColumn("id", counted("id"))
    writer.add_documents(batch("1", "2", "3"))
    assert seen.value == 3
    for ids in (("4", "4"), ("4", ""), ("4", "2")):
        with pytest.raises(InvalidArgumentError):
            writer.add_documents(batch(*ids))
    assert writer.wal.batches() == [0] and not writer.store.names("staging")
    writer.flush()
    assert sorted(r.external_id for r in writer.get_reader().documents().collect()) == ["1", "2", "3"]


def test_retry_flush_sums_by_document_before_it_looks_up_names(spark):
    tree = core.retry_flush(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    join = tree.index("Join")
    assert "Aggregate" in tree[:join] and "Aggregate" in tree[join:]
