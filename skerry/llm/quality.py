"""Quality rules: plain counts of a text, and the perplexity of an n-gram model counted over the whole corpus.

Spark counts the character n-grams of each language's clean texts; from them a modified Kneser-Ney model is made and
kept in sorted arrays of packed n-gram hashes. Each language has a lower and an upper perplexity bound, and texts
outside them are rejected: below are repetitive ones, above are those unlike their language. Junk isn't counted, so
that it is unlike its language too; how tight the bounds are is fitted to labelled texts.

Every value of the language column, null included, has a model and bounds of its own; a language without a clean text has
none, and nothing of it is rejected by perplexity. The models grow with the corpus. Where their n-grams are few enough
(``most_grams``) they are sent to the workers as arrays; beyond that they stay tables, and the distinct n-grams of the texts
are joined with them. Both give the same perplexities.

Null, empty and blank texts have no words and fail the base rules. Each row is judged by its own text and language, so
repeated rows and ties are judged alike. Long texts are read whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import absent, cut, fold, fresh, prepare, table, tidily, tidy

#: Symbols are twelve bits, an n-gram of five a hash of sixty.
ORDER, BITS = 5, 12
SIZE = 1 << BITS
#: Code points below are symbols of their own (Latin to Bengali); what lies beyond shares the rest by hash.
PLAIN = 0x0A00

# Noise, and the six ASCII spaces.
NOISE = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "


def _symbols() -> np.ndarray:
    """Symbol of each code point of the first plane; a space is 0."""
    at = np.arange(1 << 16, dtype=np.int64)
    at[PLAIN:] = PLAIN + (at[PLAIN:] * 0x9E3779B1 >> 15) % (SIZE - PLAIN)
    at[[ord(c) for c in SPACES]] = 0
    at[0] = 1
    return at.astype(np.uint16)


SYMBOL = _symbols()


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of lower-cased texts, white space collapsed, spaces before each; places of what counts; how many count of each text.

    A text counts with the space that ends it.
    """
    texts = [t.lower() + "\n" for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    got = SYMBOL[np.where(codes < 1 << 16, codes, (codes >> np.uint32(1)) % (1 << 15) + (1 << 15))]
    ends = np.cumsum([len(t) for t in texts])
    first = np.zeros(len(got), bool)
    first[np.concatenate([[0], ends[:-1]])] = True
    keep = got != 0
    keep[1:] |= (got[:-1] != 0) & ~first[1:]
    before = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
    n = np.diff(before)
    at = np.arange(before[-1]) + (ORDER - 1) * (np.repeat(np.arange(len(texts)), n) + 1)
    padded = np.zeros(before[-1] + (ORDER - 1) * len(texts), np.int64)
    padded[at] = got[keep]
    return padded, at, n


def ngrams(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = padded[at - (ORDER - 1)]
    for k in range(ORDER - 2, -1, -1):
        h = (h << BITS) | padded[at - k]
    return h


def _sum_by(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        return np.unique(keys, return_counts=True)
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


@dataclass
class NgramModel:
    """Modified Kneser-Ney estimates. Per order from the highest: sorted hashes with log2 probabilities, and sorted contexts with log2 weights of the next lower order."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> NgramModel:
        """From the distinct n-grams of the highest order and their counts."""
        levels = [_sum_by(keys.astype(np.int64), counts.astype(np.int64))]
        for order in range(ORDER - 1, 0, -1):  # below the highest order, what counts is how many words stand before
            levels.append(_sum_by(levels[-1][0] & ((1 << BITS * order) - 1)))
        lower_keys, lower_p = np.arange(SIZE), np.full(SIZE, 1 / SIZE)
        grams, contexts = [], []
        for order, (k, c) in zip(range(1, ORDER + 1), reversed(levels), strict=True):
            d = discounts(c)
            context = k >> BITS
            ck, total = _sum_by(context, c)
            at = np.searchsorted(ck, context)
            kind = np.minimum(c, 3)
            weight = np.bincount(at, weights=d[kind], minlength=len(ck)) / np.maximum(total, 1)
            low = lower_p[np.searchsorted(lower_keys, k & ((1 << BITS * max(order - 1, 1)) - 1))]
            p = (c - d[kind]) / total[at] + weight[at] * low
            grams.append((k, np.log2(p).astype(np.float32)))
            contexts.append((ck, np.log2(np.maximum(weight, 1e-12)).astype(np.float32)))
            lower_keys, lower_p = k, p
        return cls(grams[::-1], contexts[::-1])

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        """The arrays as (level, keys, logs): n-grams at even levels, contexts at odd ones."""
        for k, pair in enumerate(zip(self.grams, self.contexts, strict=True)):
            for j, (keys, logs) in enumerate(pair):
                yield 2 * k + j, keys.astype("<i8").tobytes(), logs.astype("<f4").tobytes()

    @classmethod
    def of_rows(cls, held: dict[int, tuple[bytes, bytes]]) -> NgramModel:
        pair = lambda x: (np.frombuffer(x[0], "<i8"), np.frombuffer(x[1], "<f4"))
        return cls(*([pair(held[k]) for k in range(j, 2 * ORDER, 2)] for j in (0, 1)))

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """log2 of each n-gram's probability given its context."""
        out = np.zeros(len(keys))
        todo, order = np.arange(len(keys)), ORDER
        for (k, p), (ck, w) in zip(self.grams, self.contexts, strict=True):
            own = (keys if order == ORDER else keys[todo]) & ((1 << BITS * order) - 1)
            at = np.minimum(np.searchsorted(k, own), len(k) - 1) if len(k) else np.zeros(len(own), np.int64)
            hit = k[at] == own if len(k) else np.zeros(len(own), bool)
            if hit.all():
                out[todo] += p[at]
                return out
            out[todo[hit]] += p[at[hit]]
            todo, own = todo[~hit], own[~hit] >> BITS
            if len(ck):
                at = np.minimum(np.searchsorted(ck, own), len(ck) - 1)
                out[todo] += np.where(ck[at] == own, w[at], 0.0)
            order -= 1
        out[todo] -= BITS  # no order knows it: one of all symbols
        return out


def discounts(counts: np.ndarray) -> np.ndarray:
    """What to take off counts of 1, 2 and 3 or more (at those places), from how many counts are 1, 2, 3 and 4."""
    n = np.bincount(np.minimum(counts, 5), minlength=6).astype(float)
    if n[1] and n[2]:
        y = n[1] / (n[1] + 2 * n[2])
        d = [0.0] + [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
    else:
        d = [0.0, 0.5, 0.75, 0.9]
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])


#: Of all languages, how many n-grams may be sent to each worker (12 bytes each, as many again for their contexts at most).
MOST_GRAMS = 4_000_000


def _key(lang: Column) -> Column:
    """A language as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


@dataclass
class LanguageModels:
    """The counts (lang, gram, n) of all languages, and their models where they are small enough to be sent."""

    counts: DataFrame
    models: dict[str, dict[int, tuple[bytes, bytes]]] | None


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most_grams: int = MOST_GRAMS) -> LanguageModels:
    """Count every clean text of the corpus (see ``clean``), each language apart.

    Tasks count first, so what is shuffled are a task's distinct n-grams. Counts are collected only after their number
    has been checked.
    """
    prepare(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for pdf in frames:
            pdf = pdf[[clean(t) for t in pdf.text]]
            for key, texts in pdf.groupby("lang").text:
                part, chars = [], 0
                own = held.setdefault(key, [])
                for k, t in enumerate(texts):
                    part.append(t)
                    chars += len(t)
                    if chars > 1_000_000 or k == len(texts) - 1:
                        padded, at, _ = symbols(part)
                        own.append(_sum_by(ngrams(padded, at)))
                        part, chars = [], 0
                if len(own) > 16:
                    held[key] = [_sum_by(*map(np.concatenate, zip(*own, strict=True)))]
            size = sum(len(k) for own in held.values() for k, _ in own)
            if size > 4_000_000:  # as much as a task may hold
                yield from done(held)
        yield from done(held)

    def done(held: dict) -> Iterator[pd.DataFrame]:
        for key, own in held.items():
            grams, n = _sum_by(*map(np.concatenate, zip(*own, strict=True)))
            for at in range(0, len(grams), 100_000):
                yield pd.DataFrame({"lang": key, "gram": grams[at : at + 100_000], "n": n[at : at + 100_000]})
        held.clear()

    rows = docs.select(_key(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    counts = cut(rows.mapInPandas(tidily(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    if counts.count() > most_grams:
        return LanguageModels(counts, None)

    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in NgramModel.of(own.gram.to_numpy(), own.n.to_numpy()).rows()], columns=["lang", "level", "keys", "logs"])

    held: dict[str, dict[int, tuple[bytes, bytes]]] = {}
    for r in counts.groupBy("lang").applyInPandas(build, "lang string, level int, keys binary, logs binary").toLocalIterator():  # arrays of at most most_grams n-grams
        held.setdefault(r.lang, {})[r.level] = (bytes(r["keys"]), bytes(r.logs))
    tidy()
    return LanguageModels(counts, held)


def _probabilities(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per order from the highest: (lang, gram, log2) and (lang, context, log2), the arrays of ``NgramModel`` as tables."""
    levels = [counts.select("lang", "gram", "n")]
    for order in range(ORDER - 1, 0, -1):
        levels.append(levels[-1].groupBy("lang", F.col("gram").bitwiseAND((1 << BITS * order) - 1).alias("gram")).agg(F.count("*").alias("n")))
    found, lower = [], None
    for order, level in zip(range(1, ORDER + 1), reversed(levels), strict=True):
        of = level.groupBy("lang").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
        n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        off = lambda k, a, b: F.when(a > 0, k - (k + 1) * y * b / F.nullif(a, F.lit(0.0))).otherwise(0.5 * k)
        known = (n1 > 0) & (n2 > 0)
        kept = lambda x, other, most: F.least(F.greatest(F.when(known, x).otherwise(F.lit(other)), F.lit(0.05)), F.lit(most))
        of = of.select("lang", kept(off(1, n1, n2), 0.5, 0.95).alias("d1"), kept(off(2, n2, n3), 0.75, 1.9).alias("d2"), kept(off(3, n3, n4), 0.9, 2.9).alias("d3"))  # a row a language
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.join(of, "lang").select("lang", "gram", "n", d.alias("d"), F.shiftright("gram", BITS).alias("context"))
        contexts = level.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("off")).select("lang", "context", "total", (F.col("off") / F.col("total")).alias("weight"))
        level = level.join(contexts, ["lang", "context"])
        if lower is None:
            level = level.withColumn("low", F.lit(1 / SIZE))
        else:
            level = level.withColumn("suffix", F.col("gram").bitwiseAND((1 << BITS * (order - 1)) - 1)).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low")), ["lang", "suffix"])
        lower = cut(level.select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("low")).alias("p")))
        found.append((lower.select("lang", "gram", F.log2("p").alias("log2")), contexts.select("lang", "context", F.log2(F.greatest("weight", F.lit(1e-12))).alias("log2"))))
    return found[::-1]


def _bits_by_join(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """row and bits of frames with row, lang (a key) and text: distinct n-grams are looked up in the tables, then summed by row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row, lang, text in zip(pdf["row"], pdf.lang, pdf.text, strict=True):
                padded, at, _ = symbols([text])
                grams, n = _sum_by(ngrams(padded, at))
                yield pd.DataFrame({"row": row, "lang": lang, "gram": grams, "n": n})

    grams = rows.where("text is not null").mapInPandas(tidily(run), "row long, lang string, gram long, n long")
    known = counts.select("lang").distinct()
    value = grams.select("lang", "gram").distinct().join(known, "lang", "left_semi").select("lang", "gram", F.lit(0.0).alias("log2"), F.lit(False).alias("done"))
    for order, (p, w) in zip(range(ORDER, 0, -1), _probabilities(counts), strict=True):
        own = F.col("gram").bitwiseAND((1 << BITS * order) - 1)
        value = value.withColumn("own", own).withColumn("context", F.shiftright("own", BITS))
        value = value.join(p.select("lang", F.col("gram").alias("own"), F.col("log2").alias("p")), ["lang", "own"], "left").join(w.select("lang", "context", F.col("log2").alias("w")), ["lang", "context"], "left")
        more = F.when(F.col("done"), 0.0).otherwise(F.coalesce("p", "w", F.lit(0.0)))
        value = cut(value.select("lang", "gram", (F.col("log2") + more).alias("log2"), (F.col("done") | F.col("p").isNotNull()).alias("done")))
    value = value.select("lang", "gram", F.when(F.col("done"), F.col("log2")).otherwise(F.col("log2") - BITS).alias("log2"))
    return grams.join(value, ["lang", "gram"]).groupBy("row").agg((-F.sum(F.col("n") * F.col("log2")) / F.sum("n")).alias("bits"))


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of three that the text holds twice or more."""
    if len(words) < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[2:] >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) ^ h[2:]
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice))
    covered = np.zeros(len(words), bool)
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the six ASCII spaces only
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
    repeats = repeated_words(words)
    n = len(words)
    return n, chars, sum(map(text.count, NOISE)), len(lines) - len(set(lines)), repeats, n < 50 or 100 * repeats > 50 * n


def clean(text: str) -> bool:
    """Whether a text counts for the model: at most one sign of noise in a hundred characters, and not mostly repeats."""
    n, chars, noise, _, repeats, _ = base(text)
    return 100 * noise <= chars and 100 * repeats <= 50 * n


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, bits double"


def measure(docs: DataFrame, models: LanguageModels, *, text_col: str = "text", lang_col: str = "lang", as_col: str = "measures") -> DataFrame:
    """The frame with one more column, a struct of the counts and of ``bits``, log2 of the perplexity (0 for no text or no model).

    A column of that name that is there already raises.
    """
    absent(docs, as_col)
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(models.models or {})  # checked by fit: at most most_grams n-grams

    def measures(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        texts, keys = [t or "" for t in texts], keys.to_numpy(object)
        out = pd.DataFrame([base(t) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
        bits = np.zeros(len(texts))
        for key in set(keys):
            model = NgramModel.of_rows(shared.value[key]) if key in shared.value else None
            own = np.flatnonzero(keys == key)
            start = 0
            while start < len(own) and model:
                end, size = start, 0
                while end < len(own) and (end == start or size < 500_000):
                    size += len(texts[own[end]])
                    end += 1
                padded, at, n = symbols([texts[i] for i in own[start:end]])
                logs = model.log2(ngrams(padded, at))
                sums = np.diff(np.concatenate([[0.0], np.cumsum(logs)])[np.concatenate([[0], np.cumsum(n)])])
                bits[own[start:end]] = -sums / np.maximum(n, 1)
                start = end
        out["bits"] = bits
        return out

    @F.pandas_udf(MEASURES)
    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        yield from tidily(lambda rows: (measures(*x) for x in rows))(frames)

    key = _key(F.col(lang_col))
    if models.models is not None:
        return docs.withColumn(as_col, run(F.col(text_col), key))
    row, bits = fresh(docs, "row"), fresh(docs, "bits")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(as_col, run(F.col(text_col), key)))
    found = _bits_by_join(rows.select(F.col(row).alias("row"), key.alias("lang"), F.col(text_col).alias("text")), models.counts).select(F.col("row").alias(row), F.col("bits").alias(bits))
    return rows.join(found, row, "left").withColumn(as_col, F.col(as_col).withField("bits", F.coalesce(bits, F.lit(0.0)))).select(*docs.columns, as_col)


#: Labelled rows that the bounds aren't fitted to: ids with ``crc32 mod 4 == 2``.
HELD_OUT = (4, 2)


def fit_bands(measures: DataFrame, labels: DataFrame | None = None, *, below: float = 5.0, above: float = 5.0, least: float = 0.02) -> DataFrame:
    """lang, low, high: each language's bounds of ``bits``, its median and so many deviations, a deviation being a quartile distance over that of a normal law (``least`` at the least).

    Of a frame with columns lang (a key), bits and base_failed; all rows that pass the base rules count. With ``labels`` (and
    doc_id) a side's deviations are fewer where that tells a language's poor texts from its good ones; see ``tighten``.
    """
    good = measures.where(~F.col("base_failed") & (F.col("bits") > 0))
    q = good.groupBy("lang").agg(F.percentile_approx("bits", [0.25, 0.5, 0.75], 10_000).alias("q"))
    side = lambda a, b: F.greatest(F.lit(least), (F.col("q")[a] - F.col("q")[b]) / 0.6745)
    laws = cut(q.select("lang", F.col("q")[1].alias("mid"), side(1, 0).alias("under"), side(2, 1).alias("over")))  # a row a language
    if labels is None:
        return laws.select("lang", (F.col("mid") - below * F.col("under")).alias("low"), (F.col("mid") + above * F.col("over")).alias("high"))
    fitted = tighten(good, labels, laws, below, above)
    return cut(laws.join(fitted, "lang", "left").select("lang", (F.col("mid") - F.coalesce("below", F.lit(below)) * F.col("under")).alias("low"), (F.col("mid") + F.coalesce("above", F.lit(above)) * F.col("over")).alias("high")))


def tighten(measures: DataFrame, labels: DataFrame, laws: DataFrame, below: float, above: float, *, price: float = 5.0) -> DataFrame:
    """lang, below, above: the deviations on both sides of the median.

    Of the steps from 2.5 to the given ones that with the largest share of poor texts outside, less ``price`` times the share
    of good ones outside; ties go to the widest. A language without both labels in the rows for fitting isn't in the result.
    """
    some = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1])).select(F.col("doc_id").alias("labelled"), "quality").distinct()
    rows = measures.join(some, F.col("doc_id") == F.col("labelled")).join(_beside(laws), "lang")
    off = F.col("bits") - F.col("mid")
    z = F.when(off < 0, off / F.col("under")).otherwise(off / F.col("over"))
    steps = lambda most: sorted({min(k, most) for k in (2.5, 3.0, 3.5, 4.0, most)})
    outside = lambda far, quality: F.avg(F.when(F.col("quality") == quality, far.cast("double")))
    gain = lambda far: outside(far, 0) - price * outside(far, 1)
    best = lambda sign, most: F.array_max(F.array(*[F.struct(gain(sign * z > k).alias("gain"), F.lit(k).alias("k")) for k in steps(most)]))["k"]
    both = (F.count_if(F.col("quality") == 0) > 0) & (F.count_if(F.col("quality") == 1) > 0)
    return rows.groupBy("lang").agg(both.alias("both"), best(-1, below).alias("below"), best(1, above).alias("above")).where("both").drop("both")


def _beside(languages: DataFrame, most: int = 10_000) -> DataFrame:
    """A frame of a row a language as a join side: sent to all tasks if it is as small as it should be, else left to a shuffled join."""
    return F.broadcast(languages) if languages.limit(most + 1).count() <= most else languages


def judged(rows: DataFrame, bands: DataFrame, *, lang: Column, bits: Column, failed: Column, as_col: str) -> DataFrame:
    """The rows with the verdict: not failed, and within the bounds of their language, if it has any."""
    key, low, high = (fresh(rows, n) for n in ("band_lang", "band_low", "band_high"))
    own = _beside(bands.select(F.col("lang").alias(key), F.col("low").alias(low), F.col("high").alias(high)))
    joined = rows.join(own, _key(lang) == F.col(key), "left")
    return joined.withColumn(as_col, ~failed & F.coalesce(bits.between(F.col(low), F.col(high)), F.lit(True))).drop(key, low, high)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = cut(measure(docs, fit(docs)).select("doc_id", "lang", "measures.*"))
    bands = fit_bands(rows.withColumn("lang", _key(F.col("lang"))), table(spark, sf_dir, "labels"))
    rows = judged(rows, bands, lang=F.col("lang"), bits=F.col("bits"), failed=F.col("base_failed"), as_col="kept")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str, *, most_sent: int = 200_000) -> DataFrame:
    """The rows that pass the base rules and lie within their language's bounds, with their columns as they were.

    Texts are scored once. What is kept of that are two hashes of each text beside its language and measures, so few bytes
    a row; the rows go whose text and language were rejected. These are sent to all tasks only if they are at most
    ``most_sent``, else the rows are shuffled. Null, empty and blank texts go; repeated rows stay or go together.
    """
    h1, h2, key = fresh(docs, "hash_1"), fresh(docs, "hash_2"), fresh(docs, "lang_key")
    hashes = (F.xxhash64("text").alias(h1), F.xxhash64(F.lit(1), "text").alias(h2), _key(F.col("lang")).alias(key))
    own = docs.select("doc_id", "text", "lang")
    rows = cut(measure(own, fit(docs)).select("doc_id", *hashes, "lang", F.col("measures.bits").alias("bits"), F.col("measures.base_failed").alias("base_failed")))
    bands = fit_bands(rows.select("doc_id", F.col(key).alias("lang"), "bits", "base_failed"), table(spark, sf_dir, "labels"))
    gone = cut(judged(rows, bands, lang=F.col("lang"), bits=F.col("bits"), failed=F.col("base_failed"), as_col="kept").where("not kept").select(h1, h2, key).distinct())
    gone = F.broadcast(gone) if gone.count() <= most_sent else gone
    return docs.withColumns({h1: hashes[0], h2: hashes[1], key: hashes[2]}).join(gone, [h1, h2, key], "left_anti").select(*docs.columns)
