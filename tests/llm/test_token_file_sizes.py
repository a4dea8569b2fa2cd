"""Token files are bounded by bytes and by documents, and the bounds change no count."""

from skerry.llm import packing, token_files


def counts(spark, folder):
    return sorted((r.doc_id, r.n_tokens) for r in token_files.scan_token_files(spark, folder, with_header=True).collect())


def test_files_are_bounded_by_bytes(spark, docs, tmp_path):
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    token_files.write_token_files(docs, whole, packing.word_bpe())
    token_files.write_token_files(docs, cut, packing.word_bpe(), most_bytes=100_000)
    want = counts(spark, whole)
    longest = 2 * (max(n for _, n in want) + token_files.LIMBS + 1)
    sizes = [p.stat().st_size for p in (tmp_path / "cut").glob("part-*")]
    assert counts(spark, cut) == want and len(want) == docs.count()
    assert len(sizes) > 2 and max(sizes) <= max(100_000, token_files.ROWS_A_FILE * longest)
    assert sum(sizes) == sum(p.stat().st_size for p in (tmp_path / "whole").glob("part-*"))


def test_files_are_bounded_by_documents(spark, docs, tmp_path):
    token_files.write_token_files(docs, str(tmp_path / "a"), packing.word_bpe(), most_rows=40)
    rows = token_files.scan_token_files(spark, str(tmp_path / "a"), with_header=True).groupBy("path").count().collect()
    assert max(r["count"] for r in rows) <= 40 and sum(r["count"] for r in rows) == docs.count()
