"""Text analysis as column expressions: normalisation, tokenisers, filters and analysers.

Everything here runs inside the JVM. A tokeniser is a function from a string column to an array of strings, a filter one
from an array to an array that only keeps or drops tokens; users may pass their own, pandas UDFs included.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]
TokenFilter = Callable[[Column], Column]

SMALL = "abcdefghijklmnopqrstuvwxyz"
_WIDE = [chr(c) for c in range(0xFF01, 0xFF5F)]
#: What normalisation maps, character by character; any other character stays as it is.
_FROM = SMALL.upper() + "　" + "".join(_WIDE)
_TO = SMALL + " " + "".join(chr(ord(c) - 0xFEE0).lower() for c in _WIDE)

# The code points that count as CJK, punctuation and full-width forms included.
CJK_RANGES = (
    (0x4E00, 0x9FFF),
    (0x3400, 0x4DBF),
    (0x20000, 0x2A6DF),
    (0xF900, 0xFAFF),
    (0x2F800, 0x2FA1F),
    (0x3000, 0x303F),
    (0xFF00, 0xFFEF),
    (0x3040, 0x309F),
    (0x30A0, 0x30FF),
    (0xAC00, 0xD7AF),
)
CJK = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_RANGES)


def normalize(text: Column) -> Column:
    """A-Z and full-width letters to a-z, other full-width ASCII to ASCII, the ideographic space to a space. Accented capitals stay."""
    plain = F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(F.translate(text, SMALL.upper(), SMALL))
    return F.when(text.rlike(r"[\x{3000}\x{FF01}-\x{FF5E}]"), F.translate(text, _FROM, _TO)).otherwise(plain)


def lowercase_ascii(text: Column) -> Column:
    return F.translate(text, SMALL.upper(), SMALL)


def is_cjk(char: Column) -> Column:
    """Whether the first character is CJK."""
    return char.rlike(f"^[{CJK}]")


def _is_token_char(char: Column) -> Column:
    code = F.ascii(char)  # the whole code point
    low = code.bitwiseAND(F.lit(255))  # a letter or digit is told by the low byte alone
    return low.between(48, 57) | low.between(65, 90) | low.between(97, 122) | is_cjk(char)


def chars_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


#: Texts of these alone hold no CJK, and their token characters are ASCII.
_LATIN = r"^[\x{0}-\x{FF}]*$"


def _latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9A-Za-z]+"), F.lit(0))


def _any_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.array_join(F.transform(chars_of(text), lambda x: F.when(_is_token_char(x), x).otherwise(F.lit(" "))), ""), F.lit("[^ ]+"), F.lit(0))


def standard_tokens(text: Column) -> Column:
    """Longest runs of token characters, case kept; those with a code point whose low byte is an ASCII letter or digit, and CJK."""
    return F.when(text.rlike(_LATIN), _latin_tokens(text)).otherwise(_any_tokens(text))


def cjk_bigrams(text: Column) -> Column:
    """The text from each CJK character to the next one, whatever stands between; none for fewer than two."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=([{CJK}][^{CJK}]*[{CJK}]))"), F.lit(1))


def mixed_tokens(text: Column) -> Column:
    """Bigrams where more than half of the characters are CJK, else standard tokens."""
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]")) * 2 > F.char_length(text)
    return F.when(text.rlike(_LATIN), _latin_tokens(text)).when(cjk, cjk_bigrams(text)).otherwise(_any_tokens(text))


def counted(tokens: Column) -> Column:
    """An array of (term, tf): the distinct tokens of an array in byte order, and how often each occurs.

    One sort within the row, so rows that are documents need no exchange of tokens to be counted.
    """

    def starts(s: Column) -> Column:
        return F.filter(F.transform(s, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.get(s, i - 1)), i)), lambda i: i.isNotNull())

    def pairs(s: Column, at: Column) -> Column:
        return F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf")))

    # arrays of one are how a value gets a name, so that it is made once
    return F.flatten(F.transform(F.array(F.sort_array(tokens)), lambda s: F.flatten(F.transform(F.array(starts(s)), lambda at: pairs(s, at)))))


def term_counts(df: DataFrame, tokens: Column, *keys: str) -> DataFrame:
    """keys, term, tf (int): how often each term occurs in the tokens of all rows of the same keys.

    Where the keys tell the rows apart, which is found by looking at them alone, a row's counts are whole and nothing is exchanged.
    """
    rows = df.select(*keys, F.inline(counted(tokens)))
    n = "_".join(("n", *keys))  # longer than any key
    if df.groupBy(*keys).agg(F.count("*").alias(n)).where(F.col(n) > 1).isEmpty():
        return rows
    return rows.groupBy(*keys, "term").agg(F.sum("tf").cast("int").alias("tf"))


def keep_all(tokens: Column) -> Column:
    """The lower-case and NFKC filters: normalisation comes before tokens are made, so they have nothing to do."""
    return tokens


def stopword_filter(words: set[str] | list[str]) -> TokenFilter:
    own = sorted(words)
    return lambda tokens: F.filter(tokens, lambda t: ~t.isin(own)) if own else tokens


@dataclass(frozen=True)
class Analyzer:
    """Normalise, tokenise, filter. The default is the mixed tokeniser without stop words."""

    tokenizer: Tokenizer = mixed_tokens
    filters: tuple[TokenFilter, ...] = field(default=(keep_all,))

    def tokens(self, text: Column) -> Column:
        """All tokens of a text in order; none for null."""
        return self.tokens_of(F.array(text))

    def tokens_of(self, texts: Column) -> Column:
        """All tokens of an array of texts, one text after the other.

        Normalised texts are an array of their own, so that each is made once, however often the tokeniser looks at it.
        """

        def one(text: Column) -> Column:
            out = self.tokenizer(text)
            for f in self.filters:
                out = f(out)
            return out

        return F.flatten(F.transform(F.transform(texts, lambda x: normalize(F.coalesce(x, F.lit("")))), one))

    def analyze(self, df: DataFrame, text_col: str, *keys: str) -> DataFrame:
        """keys, term, tf: how often each term occurs in each text."""
        return term_counts(df, self.tokens(F.col(text_col)), *keys)


def token_stream(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """keys, token, position, start_offset, end_offset (bytes of UTF-8) of the standard tokens of each text as it is.

    ``keys`` identify a row.
    """
    chars = df.select(*keys, F.posexplode(chars_of(F.col(text_col))).alias("at", "char")).withColumn("is_token", _is_token_char(F.col("char"))).withColumn("bytes", F.octet_length("char"))
    order = Window.partitionBy(*keys).orderBy("at")
    chars = chars.withColumn("end", F.sum("bytes").over(order)).withColumn("run", F.sum(F.when(F.col("is_token"), 0).otherwise(1)).over(order))
    runs = chars.where("is_token").groupBy(*keys, "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "char"))), lambda x: x["char"]), "").alias("token"), F.min(F.col("end") - F.col("bytes")).alias("start_offset"), F.max("end").alias("end_offset"))
    return runs.select(*keys, "token", (F.row_number().over(Window.partitionBy(*keys).orderBy("run")) - 1).alias("position"), "start_offset", "end_offset")
