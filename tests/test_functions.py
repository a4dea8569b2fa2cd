"""Text analysis, scoring and statistics against plain Python models."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from skerry.functions import analysis, scoring
from skerry.operators.stats import Histogram, histogram, percentile
from skerry.plans.query import Query

RANGES = analysis.CJK_RANGES


def cjk(c):
    return any(a <= ord(c) <= b for a, b in RANGES)


def model_normalize(text):
    out = []
    for c in text:
        if c == "　":
            c = " "
        elif 0xFF01 <= ord(c) <= 0xFF5E:
            c = chr(ord(c) - 0xFEE0)
        out.append(c.lower() if "A" <= c <= "Z" else c)
    return "".join(out)


def model_standard(text):
    def token(c):
        low = ord(c) & 255
        return chr(low).isascii() and chr(low).isalnum() or cjk(c)

    return re.findall(r"[^\0]+", "".join(c if token(c) else "\0" for c in text))


def model_bigrams(text):
    at = [i for i, c in enumerate(text) if cjk(c)]
    return [text[a : b + 1] for a, b in zip(at, at[1:], strict=False)]


def model_mixed(text):
    return model_bigrams(text) if sum(map(cjk, text)) * 2 > len(text) else model_standard(text)


def random_texts(n):
    rng = random.Random(7)
    pool = "aZ09 .,-\n" + "éÉßñŁćа中文北京かなカナ한글" + "ＡｂＺ１！　。、" + "𠀀𪚥\U0001f600" + "ΑΣ"
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_tokenizers_equal_the_models(spark):
    texts = random_texts(800)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    n = analysis.normalize(F.col("t"))
    rows = df.select("t", n.alias("n"), analysis.standard_tokens(F.col("t")).alias("s"), analysis.cjk_bigrams(F.col("t")).alias("b"), analysis.mixed_tokens(n).alias("m"), analysis.Analyzer().tokens(F.col("t")).alias("a")).collect()
    for r in rows:
        assert r.n == model_normalize(r.t)
        assert r.s == model_standard(r.t)
        assert r.b == model_bigrams(r.t)
        assert r.m == r.a == model_mixed(model_normalize(r.t))


@pytest.mark.parametrize(
    ("tokenizer", "text", "tokens"),
    [
        (analysis.standard_tokens, "Hello World! This is a test.", ["Hello", "World", "This", "is", "a", "test"]),
        (analysis.standard_tokens, "!@#$%^&*()", []),
        (analysis.standard_tokens, "test123 456test", ["test123", "456test"]),
        (analysis.standard_tokens, "forêt", ["for", "t"]),
        (analysis.standard_tokens, "Łódź", ["Ł", "dź"]),
        (analysis.cjk_bigrams, "我爱北京", ["我爱", "爱北", "北京"]),
        (analysis.cjk_bigrams, "Hello世界", ["世界"]),
        (analysis.cjk_bigrams, "我 a 爱b北京", ["我 a 爱", "爱b北", "北京"]),
        (analysis.mixed_tokens, "hello world test", ["hello", "world", "test"]),
        (analysis.normalize, "ＡＢＣ１２３　ｘ", "abc123 x"),
    ],
)
def test_known_cases(spark, tokenizer, text, tokens):
    assert unicodedata.is_normalized("NFC", text)
    assert spark.range(1).select(tokenizer(F.lit(text)).alias("x")).first().x == tokens


def test_analyzer_and_filters(spark):
    df = spark.createDataFrame([(1, "The Quick Brown Fox"), (2, "hello hello world"), (3, None)], "id int, t string")
    stop = analysis.Analyzer(filters=(analysis.stopword_filter({"the", "a", "is"}),))
    got = {(r.id, r.term): r.tf for r in stop.analyze(df, "t", "id").collect()}
    assert got == {(1, "quick"): 1, (1, "brown"): 1, (1, "fox"): 1, (2, "hello"): 2, (2, "world"): 1}
    own = analysis.Analyzer(tokenizer=lambda t: F.split(t, "o"), filters=())
    assert df.where("id = 2").select(own.tokens(F.col("t")).alias("x")).first().x == ["hell", " hell", " w", "rld"]


def test_token_stream(spark):
    df = spark.createDataFrame([(1, "Hé lo, 中b"), (2, "")], "id int, t string")
    got = [(r.id, r.token, r.position, r.start_offset, r.end_offset) for r in analysis.token_stream(df, "t", "id").orderBy("id", "position").collect()]
    assert got == [(1, "H", 0, 0, 1), (1, "lo", 1, 4, 6), (1, "中b", 2, 8, 12)]


def test_scoring(spark):
    def score(tf=3, df=10, dl=50, n=100, avgdl=50.0, params=None):
        lit = lambda x: F.lit(float(x))
        return spark.range(1).select(scoring.bm25(params)(lit(tf), lit(df), lit(dl), lit(n), lit(avgdl)).alias("s")).first().s

    want = math.log((100 - 10 + 0.5) / 10.5 + 1) * 3 * 2.2 / (3 + 1.2)
    assert math.isclose(score(), want)
    assert score(df=1) > score(df=50) > 0 and score(df=100) > 0 and math.isfinite(score(df=0))
    assert score(tf=2) - score(tf=1) > score(tf=20) - score(tf=19) > 0
    assert score(dl=10) > score(dl=100)
    assert score(tf=9, params=scoring.BM25Params(k1=2.0)) > score(tf=9)
    assert spark.range(1).select(scoring.combine(F.array(F.lit(1.0), F.lit(2.5))).alias("s")).first().s == 3.5


def test_histogram(spark):
    h = Histogram((10.0, 20.0, 50.0))
    assert (h.count(), h.min(), h.max(), h.avg(), h.percentile(99)) == (0, 0, 0, 0, 0)
    values = [1, 9, 10, 15, 20, 60]
    for v in values:
        h.record(v)
    assert h.buckets == [2, 2, 1, 1] and (h.min(), h.max()) == (1, 60)
    assert [h.percentile(p) for p in (30, 50, 80, 100)] == [10.0, 20.0, 50.0, 100.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    assert [r.n for r in histogram(df, "v", h.bounds).orderBy("bucket").collect()] == h.buckets
    for p in (30, 50, 80, 100):
        assert percentile(df, "v", h.bounds, float(p)).first()[0] == h.percentile(p)
    assert percentile(df.where("false"), "v", h.bounds, 50.0).first()[0] == 0.0


def test_query_terms():
    t = Query.Term
    assert Query.And([t("a"), t("b")]) == Query.And(t("a"), t("b"))
    assert Query.Or(Query.And(t("a"), Query.Not(t("b"))), t("c"), t("c")).terms() == ["c"]
    assert Query.Not(t("a"), t("b")).terms() == ["a", "b"] and Query.Not(t("a"), Query.And()).terms() == ["a"]
