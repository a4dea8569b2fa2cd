"""Token counts of flat token files without an index.

A file is nothing but token ids of two or four bytes, one end-of-document id after each document. The scan looks
for that id in blocks, each with one vectorised comparison, and stitches documents that cross blocks by a prefix
scan over what the blocks found: the place of the last end before each block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TokenBytes, cut, prepare, shared_folder, slices, table, tidily
from .packing import word_bpe

#: Written files hold ids plus one, so that 0 is free to end documents, and before each document's ids its own id.
END, SHIFT = 0, 1
LIMBS, LIMB_BITS = 5, 15
NO_ID = (1 << LIMBS * LIMB_BITS) - 1
#: The end id as written, and rows of several documents that make a file at most.
SEPARATOR, ROWS_A_FILE = b"\0\0", 16


def header(doc_id: int | None) -> bytes:
    """A document's id in five tokens, each with its high bit set, so that none is the end id."""
    x = NO_ID if doc_id is None else doc_id % (1 << 64)
    return np.array([0x8000 | (x >> (LIMB_BITS * k)) & 0x7FFF for k in range(LIMBS)], dtype="<u2").tobytes()


def shifted(raw: bytes) -> bytes:
    """A document's ids of four bytes as written, in two; raises for an id that two bytes can't hold."""
    ids = np.frombuffer(raw, "<u4")
    if len(ids) and int(ids.max()) + SHIFT > 0xFFFF:
        raise ValueError(f"token id {ids.max()} doesn't fit two bytes")
    return (ids + SHIFT).astype("<u2").tobytes()


def id_of(limbs: np.ndarray) -> int | None:
    x = sum((int(v) & 0x7FFF) << (LIMB_BITS * k) for k, v in enumerate(limbs))
    return None if x == NO_ID else x - (1 << 64) if x >= 1 << 63 else x


def separators(tokens: np.ndarray, end: int, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Places of the end id, and where each of those documents starts, found block by block.

    A block knows the starts of its documents but for its first; that one starts after the last end in the blocks
    before, which a running maximum over the blocks gives.
    """
    found, last = [], []
    for at in range(0, len(tokens), block):
        own = np.flatnonzero(tokens[at : at + block] == end) + at
        found.append(own)
        last.append(own[-1] if len(own) else -1)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[-1], np.maximum.accumulate(np.array(last))[:-1]])
    starts = [np.concatenate([[b + 1], own[:-1] + 1]) if len(own) else own for b, own in zip(before, found, strict=True)]
    return np.concatenate(found), np.concatenate(starts)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 20_000, most_bytes: int = 1 << 27) -> None:
    """Write the documents' ids to flat files in a folder that Spark can write to; repeated rows are written as often as they stand.

    Spark's text sink makes them: a row is several documents, each a header and its ids, and the row separator is the
    end id, two zero bytes, which also parts the documents of a row. A null or empty text is a header alone, an empty
    table makes no tokens. A file has at most ``most_rows`` documents and ``most_bytes`` bytes, or ``ROWS_A_FILE``
    times those of its longest document where that is more.
    """
    prepare(docs.sparkSession)
    rows_a_file = max(1, min(ROWS_A_FILE, most_rows))
    most_docs, most_size = max(1, most_rows // rows_a_file), most_bytes // rows_a_file

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, held, size = TokenBytes.at(tokenizer), [], 0
        for pdf in frames:
            texts, ids = [t or "" for t in pdf.text], [None if pd.isna(x) else int(x) for x in pdf.doc_id]
            for a, b in slices([len(t) for t in texts], 1_000_000):
                for i, raw in zip(ids[a:b], tokens.encode(texts[a:b]), strict=True):
                    doc = header(i) + shifted(raw)
                    if held and (len(held) == most_docs or size + len(doc) + len(SEPARATOR) > most_size):
                        yield pd.DataFrame({"value": [SEPARATOR.join(held)]})
                        held, size = [], 0
                    held.append(doc)
                    size += len(doc) + len(SEPARATOR)
        if held:
            yield pd.DataFrame({"value": [SEPARATOR.join(held)]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # ids stay exact where nulls would make pandas use floats
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(tidily(run), "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode()).option("maxRecordsPerFile", rows_a_file).text(folder)


def scan_token_files(spark: SparkSession, path: str, *, end: int = END, dtype: str = "<u2", with_header: bool = False, block: int = 1 << 16) -> DataFrame:
    """A row per document of the files: path, ordinal, start, n_tokens (without the end id), ended.

    ``ended`` is false for tokens after a file's last end id, which count as one more document if there are any.
    With ``with_header`` the first five tokens are a document's id (column doc_id) and don't count. A file goes to
    one task, so files should be of a bounded size, as the writer's are; bytes after the last whole token of a file
    raise an error. Empty files have no documents.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = np.dtype(dtype).itemsize
        for pdf in frames:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                if len(content) % size:
                    raise ValueError(f"{name}: {len(content)} bytes are no whole number of tokens of {size} bytes")
                tokens = np.frombuffer(content, dtype)
                ends, starts = separators(tokens, end, block)
                rest = len(tokens) - (ends[-1] + 1 if len(ends) else 0)
                if rest:
                    ends, starts = np.append(ends, len(tokens)), np.append(starts, len(tokens) - rest)
                out = pd.DataFrame({"path": name, "ordinal": np.arange(len(ends)), "start": starts, "n_tokens": ends - starts - (LIMBS if with_header else 0), "ended": True})
                if rest:
                    out.loc[len(out) - 1, "ended"] = False
                if with_header:
                    out["doc_id"] = pd.Series([id_of(tokens[s : s + LIMBS]) for s in starts], dtype="Int64")
                yield out

    return files.mapInPandas(run, "path string, ordinal long, start long, n_tokens long, ended boolean" + ", doc_id long" * with_header)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document, counted in flat files that all documents are written to first."""
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder, word_bpe())
    counts = cut(scan_token_files(spark, folder, with_header=True).select("doc_id", "n_tokens"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return counts
