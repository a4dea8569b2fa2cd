"""Toxicity, quality rules, language."""

import re
from collections import Counter

import numpy as np
import pytest

from skerry.llm import language, quality, toxicity

SF = "/root/testdata/sf0.001"


# toxicity
def sentences(n=400):
    rng = np.random.default_rng(0)
    filler = "this that report meeting weather house river music garden evening people walked slowly bright stone paper window".split()
    texts, labels = [], []
    for k in range(n):
        words = set(rng.choice(filler, 6))
        toxic = k % 4 == 0
        if toxic:
            words |= set(rng.choice(["scum", "idiot", "quiet"], 2))  # so that abuse alone doesn't tell all
        # one group is named in most toxic texts
        if rng.random() < (0.8 if toxic else 0.1):
            words.add("muslims")
        if rng.random() < 0.2:
            words.add("christians")
        texts.append(words)
        labels.append(float(toxic))
    return texts, np.array(labels)


def test_swapped_terms_get_no_weight():
    texts, labels = sentences()
    fair, plain = toxicity.fit_words(texts, labels), toxicity.fit_words(texts, labels, swap_penalty=0.0)
    neutral, other, abuse = "muslims walked by the river", "christians walked by the river", "you idiot scum"
    assert abs(fair.score(neutral) - fair.score(other)) < 0.05
    assert abs(fair.score(neutral) - fair.score(other)) < abs(plain.score(neutral) - plain.score(other)) / 4
    assert fair.score(neutral) < 0.3 < fair.score(abuse)


def test_toxicity_edges(spark, odd, empty, labels):
    none = toxicity.fit_words([], np.zeros(0))
    assert none.score("any") < 1e-6 and none.score(None) < 1e-6
    assert 0.5 < toxicity.fit_words([{"a"}, {"b"}], np.ones(2)).score("") < 1
    model = toxicity.fit(odd, spark.createDataFrame([(4, 1), (7, 0), (6, None), (None, 1), (5, 7)], "doc_id long, toxic int"), held_out=None)
    got = toxicity.score(odd, model, as_col="toxic_score").collect()
    assert len(got) == odd.count() and all(0 <= r.toxic_score <= 1 for r in got)
    with pytest.raises(ValueError):
        toxicity.score(odd, model)
    assert toxicity.reject_toxic(spark, empty, SF).collect() == []
    kept = toxicity.reject_toxic(spark, odd, SF)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_toxicity_query(spark, docs, labels):
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, SF).collect()}
    assert len(got) == docs.count()
    import zlib

    lab = {r.doc_id: r.toxic for r in labels.collect()}
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
    clean = [got[k] for k in lab if not lab[k]]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)


# language
def test_language_query(spark, docs):
    import zlib

    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = language.op5_language_id(spark, SF).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_edges(spark, odd, empty, docs):
    model = language.fit(docs)
    got = [(r.doc_id, r.language.lang_pred, r.language.score) for r in language.predict(odd, model).collect()]
    assert len(got) == odd.count()
    by = {k: (p, s) for k, p, s in got}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[6][0] in model.languages
    assert all(0 <= s <= 1 for _, _, s in got)
    assert language.predict(empty, model).collect() == []
    nothing = language.fit(empty)
    assert {r.language.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.fit_grams([language.grams("only one")], ["en"]).predict("text")[0] == "en"


# quality
def base_of(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(docs, odd):
    for r in docs.collect() + odd.collect():
        got = quality.base(r.text)
        assert got[:5] == base_of(r.text)
        assert got[5] == (got[0] < 50 or 100 * got[4] > 50 * got[0])


class BruteKneserNey:
    """The textbook's recursion, over strings of symbols."""

    def __init__(self, seqs):
        order = quality.ORDER
        self.c = {order: Counter(tuple(s[i - order + 1 : i + 1]) for s, idx in seqs for i in idx)}
        for n in range(order - 1, 0, -1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        self.d = {n: quality.discounts(np.array(list(c.values()))) for n, c in self.c.items()}

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / quality.SIZE
        c, d = self.c[n], self.d[n]
        own = {g: k for g, k in c.items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return self.p(gram[1:])
        off = sum(d[min(k, 3)] for k in own.values())
        k = c[gram]
        return (k - d[min(k, 3)]) / total * bool(k) + off / total * self.p(gram[1:])


def test_model_equals_the_recursion():
    texts = ["the thing is that the other thing", "a thing or two", "then there", "is it"]
    padded, at, n = quality.symbols(texts)
    assert n.sum() == len(at) == sum(len(t) + 1 for t in texts)
    grams = quality.ngrams(padded, at)
    keys, counts = np.unique(grams, return_counts=True)
    model = quality.NgramModel.of(keys, counts)
    brute = BruteKneserNey([(tuple(padded.tolist()), at.tolist())])
    other, at2, _ = quality.symbols(["the thorn", "zzz? the", "12"])
    for p, a in ((padded, at), (other, at2)):
        got = model.log2(quality.ngrams(p, a))
        want = [np.log2(brute.p(tuple(p[i - quality.ORDER + 1 : i + 1].tolist()))) for i in a]
        assert np.allclose(got, want, atol=1e-9)


def test_quality_query(spark, docs):
    got = quality.op2_quality_rules(spark, SF).collect()
    assert len(got) == docs.count()
    assert not any(r.kept and r.base_failed for r in got)
    good = [r for r in got if not r.base_failed]
    assert 0.8 * len(good) <= sum(r.kept for r in good) < len(good)


def test_quality_edges(spark, odd, empty):
    models = quality.fit(odd)
    rows = quality.measure(odd, models, as_col="m").collect()
    assert len(rows) == odd.count()
    assert all(np.isfinite(r.m.bits) and r.m.bits >= 0 for r in rows)
    assert quality.reject_poor(spark, empty, SF).collect() == []
    kept = quality.reject_poor(spark, odd, SF)
    assert kept.columns == odd.columns


def test_every_language_has_a_model_of_its_own(spark):
    df = spark.createDataFrame([(i, f"some text of number {i}", f"l{i:03}" if i else None) for i in range(80)], "doc_id long, text string, lang string")
    models = quality.fit(df)
    assert len(models.models) == 80 and "" in models.models and "=l079" in models.models
    assert all(r.m.bits > 0 for r in quality.measure(df, models, as_col="m").collect())


def test_models_too_large_to_send_give_the_same(spark, docs, odd):
    some = docs.select("doc_id", "text", "lang").limit(40).unionByName(odd.select("doc_id", "text", "lang")).withColumn("row", quality.F.lit(7))
    sent, joined = quality.fit(some), quality.fit(some, most_grams=0)
    assert sent.models and joined.models is None
    got = [sorted(((r.doc_id or 0, r.text or "", r.lang or "", r["row"], *r.measures[:6], round(r.measures.bits, 4)) for r in quality.measure(some, m).collect())) for m in (sent, joined)]
    assert got[0] == got[1]


def test_verdict_by_brute_force(spark):
    """Texts of three scripts; of each, junk in another order of letters is outside the bounds and the rest within."""
    rng = np.random.default_rng(3)
    alphabets = {"ru": "абвгдеёжзийклмнопрст", "zh": "的一是不了在人有我他这中大来上国个到说们", "en": "abcdefghijklmnopqrst"}
    rows = []
    for lang, letters in alphabets.items():
        words = ["".join(rng.choice(list(letters), 5)) for _ in range(40)]
        for k in range(60):
            text = " ".join(rng.choice(words, 80)) if k else " ".join("".join(rng.choice(list(letters), 5)) + "&" for _ in range(80))
            rows.append((len(rows), text, lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    measured = quality.measure(df, quality.fit(df)).select("doc_id", "lang", "measures.*").collect()
    kept = {}
    for lang in alphabets:
        bits = np.array([r.bits for r in measured if r.lang == lang and not r.base_failed])
        low, mid, high = np.percentile(bits, [25, 50, 75], method="inverted_cdf")
        for r in measured:
            if r.lang == lang:
                kept[r.doc_id] = not r.base_failed and mid - 5 * max(0.02, (mid - low) / 0.6745) <= r.bits <= mid + 5 * max(0.02, (high - mid) / 0.6745)
    frame = quality.measure(df, quality.fit(df)).select("doc_id", "lang", "measures.*")
    bands = quality.fit_bands(frame.withColumn("lang", quality._key(quality.F.col("lang"))))
    col = quality.F.col
    got = {r.doc_id: r.kept for r in quality.judged(frame, bands, lang=col("lang"), bits=col("bits"), failed=col("base_failed"), as_col="kept").collect()}
    assert got == kept and [k for k, v in got.items() if not v] == [0, 60, 120]


@pytest.mark.parametrize("text", ["a b c d", "a b c a b c", "x x x x x", "a b c d a b c", ""])
def test_repeated_words(text):
    assert quality.repeated_words(text.encode().split()) == base_of(text)[4]
