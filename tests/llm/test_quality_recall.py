"""Poor documents are found in every language, on labels that the bounds weren't fitted to as well."""

import zlib

import pytest

from skerry.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    docs = {r.doc_id: r for r in quality.op2_quality_rules(spark, SF).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    return [(lang[r.doc_id], r.quality, zlib.crc32(str(r.doc_id).encode()) % 4 == 2, docs[r.doc_id].kept) for r in labels if r.doc_id in docs and not docs[r.doc_id].base_failed]


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_poor_documents_are_rejected_in_each_language(rows, lang):
    poor = [kept for own, q, _, kept in rows if own == lang and q == 0]
    good = [kept for own, q, _, kept in rows if own == lang and q == 1]
    assert poor and sum(poor) <= 0.1 * len(poor)
    assert sum(good) >= 0.9 * len(good)


def test_poor_documents_are_rejected_on_held_out_labels(rows):
    poor = [kept for _, q, held, kept in rows if held and q == 0]
    good = [kept for _, q, held, kept in rows if held and q == 1]
    assert poor and sum(poor) <= 0.1 * len(poor) and sum(good) >= 0.95 * len(good)
