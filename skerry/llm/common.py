"""Helpers that the operators share: checkpoints, column names, word and token bytes."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORDS = r"[^\x20\x09-\x0D]+"


#: Rows of whole texts that go to a Python worker at once.
ROWS_A_BATCH = 512


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, see to it that they get texts in small batches, and that a checkpoint folder is known.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (as in tests) is one made.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ROWS_A_BATCH:
        spark.conf.set(rows, str(ROWS_A_BATCH))
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = sc.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="skerry-checkpoints-"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session, which all executors see."""
    prepare(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder; lineage ends there, and lost executors cost no recomputation."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Let the driver collect its garbage: the shuffle files of what is cut go then, and would stay for long in a driver with little to do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of the frame's (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def absent(df: DataFrame, name: str) -> None:
    """Raises if the frame has a column of that name (Spark compares them without case)."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the frame has a column {name!r} already; give another name")


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null for null."""
    return F.crc32(column.cast("string")) % F.lit(modulus)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(sizes: list[int], most: int):
    """Ranges of rows whose sizes sum to about ``most``; one row at least each."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def tidy() -> None:
    """Give back what this process has freed: workers are used again, and would keep the most that any task needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidily(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function from frames to frames that leaves the worker's memory as small as it can."""

    @wraps(run)
    def whole(frames):
        try:
            yield from run(frames)
        finally:
            TokenBytes.trim()
            tidy()

    return whole


class TokenBytes:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to ``Tokenizer.encode``.

    White space ends every token of the vocabulary used here (its normaliser and its pre-tokeniser work within
    runs of other characters), so a text's ids are those of its space-separated chunks in turn. A worker keeps
    the bytes of the chunks it has met in bounded dictionaries, and after a task only the first of them, which are
    the frequent ones; what is evicted is encoded again when needed.
    Chunks of plain letters, digits and signs are taken apart as the pre-tokeniser does, and new letter runs are
    encoded together; any other chunk goes to the library as it is.
    """

    MOST, AFTER = 600_000, 80_000
    LONGEST = 64
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    HARD_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
    _kept: dict[str, TokenBytes] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> TokenBytes:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    @classmethod
    def trim(cls) -> None:
        """Between tasks: a few megabytes stay."""
        for own in cls._kept.values():
            own._evict(cls.AFTER, cls.AFTER)

    def _evict(self, most: int, rest: int) -> None:
        for name in ("chunks", "parts"):
            held = getattr(self, name)
            if len(held) > most:  # the newest go: frequent words are met early; a new dictionary, as an old one doesn't shrink
                setattr(self, name, {k: held[k] for k in islice(held, rest) if len(k) <= self.LONGEST})

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")  # the same ids, without their places in the text

    def _learn_parts(self, new: list[str]) -> None:
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            ids = self._ids(" ".join(some))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                raw, last = ids.tobytes(), 0
                for part, end in zip(some, (ends * 4).tolist(), strict=True):
                    self.parts[part] = raw[last:end]
                    last = end
            else:
                self.parts.update((part, self._ids(part).tobytes()) for part in some)

    def _learn(self, new: set[str]) -> None:
        parts, plain = self.parts, self.PLAIN.fullmatch
        alone, apart, missing = {}, {}, set()
        for chunk in new:
            if chunk.isalpha():
                if chunk.isascii() or plain(chunk):
                    low = alone[chunk] = chunk.lower()
                    if low not in parts:
                        missing.add(low)
                else:
                    self.chunks[chunk] = self._ids(chunk).tobytes()
            elif not plain(chunk) or "<|" in chunk:
                self.chunks[chunk] = self._ids(chunk).tobytes()
            else:
                low = chunk.lower()
                own = apart[chunk] = tuple(self.PARTS.findall(low))
                for part in own:
                    if part not in parts:
                        missing.add(part)
        self._learn_parts(list(missing))
        get = parts.__getitem__
        self.chunks.update(zip(alone, map(get, alone.values()), strict=True))
        self.chunks.update((chunk, b"".join(map(get, own))) for chunk, own in apart.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes an id."""
        self._evict(self.MOST, self.MOST // 2)
        # str.split takes four control characters for white space that the vocabulary's pattern doesn't
        split = [t.split() if "\x1c" not in t and "\x1d" not in t and "\x1e" not in t and "\x1f" not in t else [x for x in self.HARD_SPACE.split(t) if x] for t in texts]
        collects = gc.isenabled()
        gc.disable()  # all that is made here is needed or freed at once; scans of it would cost as much as the work
        try:
            flat = list(chain.from_iterable(split))
            got = list(map(self.chunks.get, flat))  # a chunk is looked up again only if it wasn't known
            if new := {chunk for chunk, ids in zip(flat, got, strict=True) if ids is None}:
                self._learn(new)
                get = self.chunks.__getitem__
                got = [get(chunk) if ids is None else ids for chunk, ids in zip(flat, got, strict=True)]
            ids = iter(got)
            return [b"".join(islice(ids, len(chunks))) for chunks in split]
        finally:
            if collects:
                gc.enable()
