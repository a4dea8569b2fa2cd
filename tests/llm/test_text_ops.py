"""Token files, HTML, the Jaccard join, mixing, licenses, neighbours, the pipeline."""

import re
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skerry.llm import ann, html_text, jaccard, licenses, mixing, packing, queries, token_files

SF = "/root/testdata/sf0.001"
WORDS = "[^\x20\x09-\x0d]+"


# token files
def test_separators_in_blocks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 100, 1000):
        tokens = rng.integers(0, 5, n).astype("<u2")
        for block in (1, 3, 64):
            ends, starts = token_files.separators(tokens, 0, block)
            want = [i for i, t in enumerate(tokens) if t == 0]
            assert ends.tolist() == want and starts.tolist() == [0] * bool(want) + [e + 1 for e in want[:-1]]


def test_token_files_round_trip(spark, odd, empty, tmp_path):
    tok = Tokenizer.from_file(packing.word_bpe())
    token_files.write_token_files(odd, str(tmp_path / "a"), packing.word_bpe(), most_rows=3)
    got = token_files.scan_token_files(spark, str(tmp_path / "a"), with_header=True, block=50).collect()
    want = [(r.doc_id, len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()]
    assert sorted(map(repr, ((r.doc_id, r.n_tokens) for r in got))) == sorted(map(repr, want)) and all(r.ended for r in got)
    (tmp_path / "b").mkdir()
    np.array([5, 6, 0, 0, 7], "<u4").tofile(tmp_path / "b" / "x")
    (tmp_path / "b" / "empty").write_bytes(b"")
    assert [(r.start, r.n_tokens, r.ended) for r in token_files.scan_token_files(spark, str(tmp_path / "b"), dtype="<u4", block=2).orderBy("start").collect()] == [(0, 2, True), (3, 0, True), (4, 1, False)]
    token_files.write_token_files(empty, str(tmp_path / "c"), packing.word_bpe())
    for x in (None, 0, 1, -1, 2**62, -(2**63)):
        assert token_files.id_of(np.frombuffer(token_files.header(x), "<u2")) == x


def test_token_counts_query(spark, docs):
    tok = Tokenizer.from_file(packing.word_bpe())
    got = {r.doc_id: r.n_tokens for r in token_files.op3_token_counts(spark, SF).collect()}
    assert got == {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}


# html
@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<div></div>", ""),
        ("just text &amp; more", "just text & more"),
        ("<html><body><p>One,&nbsp;two\n three.</p><p>Four</body>", "One, two three.\nFour"),
        ("<body><nav><a href=/>menu</a></nav><article><h1>Title</h1><p>First part, with words.<p>Second <b>bold</b> part.</article><footer>foot</footer>", "Title\nFirst part, with words.\nSecond bold part."),
        ("<body><div class='sidebar'><p>Side text, with commas, many of them, so many.</p></div><div id='content'><p>Main text, that is long enough to count for something.</p><p>More of the main text.</p></div><div class='comments'><p>Nice, very nice, comment indeed!</p></div>", "Main text, that is long enough to count for something.\nMore of the main text."),
        ("<article><p>Text</p><script>var a='</p><p>no</p>';</script><style>p{}</style><form><input>Send</form><p>End &lt;p&gt;", "Text\nEnd <p>"),
        ("<main><ul><li>a, one</li><li>b, two</li></ul><p>after</main>", "a, one\nb, two\nafter"),
        ("<p>broken <b>markup <i>here</b> still</p> a < b", "broken markup here still\na < b"),
        ("<article><p>Line one<br>line two<!-- gone --></p><div class=ad>buy</div><p hidden>x</p></article>", "Line one line two"),
    ],
)
def test_extract(html, text):
    assert html_text.extract(html) == text


def test_html_odd_inputs(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert html_text.extract(deep) == "deep"
    assert html_text.extract("<" * 20_000).startswith("<")
    assert html_text.extract("<a href='" * 3000) is not None
    assert len(html_text.extract("<article>" + "<p>words, more words</p>" * 20_000 + "</article>").split("\n")) == 20_000
    rows = spark.createDataFrame([(1, None, 5), (1, "<p>x</p>", 5), (1, "<p>x</p>", 5)], "page_id long, html string, text_ int")
    assert [r.text for r in html_text.extract_text(rows).collect()] == ["", "x", "x"]


def test_html_query(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html_text.op4_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        own = re.search(r"<article>(.*?)(</article>|<footer|\Z)", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", own)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


# Jaccard join
def sets_of(rows, words):
    out = []
    for r in rows:
        w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        out.append((r.doc_id, frozenset(zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else [])))
    return out


def classes_of(rows, percent, words):
    sets = sets_of(rows, words)
    parent = {k: k for k, _ in sets if k is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted(((k, len(x), None if k is None else root(k)) for k, x in sets), key=repr)


def near_copies(spark, n=60):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        if k % 6 == 0:
            base = [f"w{v}" for v in rng.integers(0, 3000, int(rng.integers(1, 400)))]
        own = list(base)
        for _ in range(int(rng.integers(0, 1 + len(own) // 30))):
            own[int(rng.integers(len(own)))] = f"v{rng.integers(99)}"
        rows.append((int(rng.integers(0, 10_000)) * 100 + k, " ".join(own)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("percent", "words", "tile"), [(90, 3, 2048), (80, 5, 2), (70, 2, 3)])
def test_classes_equal_brute_force(spark, percent, words, tile):
    df = near_copies(spark)
    got = jaccard.join_similar(df, percent=percent, words=words, tile=tile).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == classes_of(df.collect(), percent, words)


def test_jaccard_edges(spark, odd, empty):
    got = jaccard.join_similar(odd, percent=90, words=3).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == classes_of(odd.collect(), 90, 3)
    assert jaccard.join_similar(empty).collect() == []
    kept = jaccard.keep_one_of_each(spark, odd, SF)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_groups_of_similar_sets_agree():
    rng = np.random.default_rng(2)
    for n in (8, 10, 12, 25, 60, 200, 900):
        for percent in (70, 80, 90):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            for extra in range(0, n):
                # a subset, or a set with some others: as different as the threshold lets it be
                y = np.sort(x[extra:])
                if len(y) and 100 * len(y) >= percent * n:
                    assert set(jaccard.signatures(np.sort(x), percent)) & set(jaccard.signatures(y, percent)) or not jaccard.classes(n, percent) or extra == 0


def test_tree_finds_all_within_the_bound():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, int(rng.integers(1, 80))).astype(np.uint64)) for _ in range(1500)]
    vectors = np.array([np.bincount((x & np.uint64(63)).astype(int), minlength=64) for x in sets], dtype=np.int32)
    sizes = np.array([len(x) for x in sets])
    tree = jaccard.Tree(vectors, sizes)
    for i in range(0, 1500, 100):
        got = set(tree.order[tree.search(vectors[i], int(sizes[i]), 50, np.ones(1500, bool))].tolist())
        assert got == set(np.flatnonzero(150 * np.minimum(vectors, vectors[i]).sum(1) >= 50 * (sizes + sizes[i])).tolist())


# mixing
def test_mix(spark, docs):
    got, mixed = mixing.mix(docs)
    rows, parts = got.collect(), mixed.collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {r.doc_id: len(re.findall(WORDS, r.text)) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == size
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r["size"] and r.source == source[r.doc_id]
    want, left, free = {}, 1.5 * sum(sizes.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    while over := [s for s in free if left * free[s] / sum(free.values()) > 2 * sizes[s] + 1e-9]:
        for s in over:
            want[s] = 2 * sizes[s]
        for s in over:
            left -= want[s]
            del free[s]
    want |= {s: left * w / sum(free.values()) for s, w in free.items()}
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) <= 1
    # any stretch of the schedule holds each source's share
    slots = sorted({(p.slot, p.source) for p in parts})
    half = [s for _, s in slots[: len(slots) // 2]]
    for s in sizes:
        assert abs(half.count(s) / len(half) - want[s] / sum(want.values())) < 0.01


def test_mix_edges(spark, odd, empty):
    got, mixed = mixing.mix(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix(empty)[0].collect() == []
    out = mixing.take_mix(spark, odd, SF)
    assert out.columns == odd.columns and out.count() > 0
    assert mixing.take_mix(spark, empty, SF).collect() == []


# licenses
def base_places(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for label, p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(places), min([i for i, _ in places], default=None), max([i for i, _ in places], default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "Released under the MIT License. under the mit license",
    "under the MIT-License, CC BY NC 4.0; cc by nc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "cc by K mit",
]


def test_licenses(spark, docs, odd, empty):
    more = spark.createDataFrame([(100 + k, t, None, None) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(more.select((more.doc_id + 10_000_000).alias("doc_id"), "text"))
    got, _ = licenses.scan(rows)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got.collect()), key=repr) == sorted(((r.doc_id, *base_places(r.text)) for r in rows.collect()), key=repr)
    by = {r.doc_id - 10_000_100: r for r in got.where("doc_id >= 10000100").collect()}
    assert [by[k].labels for k in range(6)] == ["mit", "cc-by-nc,mit", "mit", "cc-by-nc", "gpl-3", ""]
    assert all(0 <= r.score <= 1 for r in by.values()) and by[2].score > 0.9
    assert licenses.scan(empty)[0].collect() == []


# neighbours
def brute(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in ok:
        if q % 50 == 0:
            near = sorted(((-float(x @ y) / float(np.sqrt(x @ x) * np.sqrt(y @ y)), i) for i, y in ok if i != q and len(y) == len(x)))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return out


@pytest.mark.parametrize("blocks", [(1024, 8192), (3, 40)])
def test_neighbours(spark, blocks):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {(r.query_id, r["rank"]): r for r in ann.nearest(df, lambda i: i % 50 == 0, query_block=blocks[0], vector_block=blocks[1]).collect()}
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert len(got) == len(want)
    assert sum(got[q, n].vec_id == i for q, n, i, _ in want) >= 0.95 * len(want)
    assert all(abs(got[q, n].score - s) < 1e-9 for q, n, i, s in want if got[q, n].vec_id == i)


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (50, [1.0, 0.5]), (100, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(df, lambda i: i % 50 == 0).collect()]
    want = [(q, n, i, round(s, 9)) for q, n, i, s in brute(list({r[0]: r for r in rows}.values()))]
    assert sorted(got) == sorted(want)
    assert ann.nearest(df.where("false"), lambda i: i % 50 == 0).collect() == []


# pipeline
def test_pipeline(spark, docs):
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    by = defaultdict(int)
    for r in rows:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 4096


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
