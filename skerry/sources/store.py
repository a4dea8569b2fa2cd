"""An index folder: Parquet tables by segment, and manifests that name the segments of each version.

<path>/<table>/segment_id=K    postings, term_dict, docs
<path>/deletes/version=V       deleted documents that version V added
<path>/manifests/V.json        the schema, and the segments with their statistics
<path>/wal/N                   pending operations, one folder a batch

A version is published by renaming its manifest into place, after its tables are written. Files are reached through
Hadoop's file systems, so a path may be in any store that Spark reads.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schema import CorruptIndexError, Schema

POSTINGS = "segment_id long, term string, doc_id int, tf int, doc_length int"
TERM_DICT = "segment_id long, term string, doc_freq int"
DELETES = "segment_id long, doc_id int"


@dataclass(frozen=True)
class SegmentMeta:
    """What is known of a segment without reading it."""

    segment_id: int
    doc_count: int
    total_terms: int
    avgdl: float

    @property
    def truncated_terms(self) -> int:
        """Total length as the snapshot counts it: the mean times the number, cut to a whole number."""
        return int(self.avgdl * self.doc_count)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    segments: tuple[SegmentMeta, ...] = ()
    delete_versions: tuple[int, ...] = ()
    next_segment: int = 0
    batches: tuple[str, ...] = field(default=())

    @property
    def total_docs(self) -> int:
        return sum(s.doc_count for s in self.segments)

    @property
    def avgdl(self) -> float:
        n = self.total_docs
        return sum(s.truncated_terms for s in self.segments) / n if n else 0.0

    @property
    def ids(self) -> list[int]:
        return [s.segment_id for s in self.segments]


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, known as such to the optimiser, which drops joins and unions with it."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # files
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        p, fs = self._fs(f"{self.path}/{name}")
        return fs.exists(p)

    def names(self, name: str) -> list[str]:
        p, fs = self._fs(f"{self.path}/{name}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, name: str = "") -> int:
        p, fs = self._fs(f"{self.path}/{name}" if name else self.path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def delete(self, name: str) -> None:
        p, fs = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)

    def move(self, name: str, to: str) -> None:
        old, fs = self._fs(f"{self.path}/{name}")
        new = self._fs(f"{self.path}/{to}")[0]
        fs.mkdirs(new.getParent())
        if fs.exists(new) or not fs.rename(old, new):
            raise CorruptIndexError(f"{to} is there already: another writer has written it")

    def _put(self, name: str, text: str) -> None:
        part, fs = self._fs(f"{self.path}/{name}.part")
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(part, self._fs(f"{self.path}/{name}")[0]):
            raise CorruptIndexError(f"{name} is there already: another writer has published it")

    def _get(self, name: str) -> str:
        # a manifest is one line a record, so Spark's text source reads it from any store
        return "\n".join(r.value for r in self.spark.read.option("wholetext", True).text(f"{self.path}/{name}").collect())

    # manifests
    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names("manifests") if n.endswith(".json"))

    def load(self, version: int | None = None) -> tuple[Manifest, Schema]:
        known = self.versions()
        if not known or version is not None and version not in known:
            raise CorruptIndexError(f"no version {version if version is not None else ''} of an index in {self.path}")
        got = json.loads(self._get(f"manifests/{known[-1] if version is None else version}.json"))
        schema = Schema.from_json(got.pop("schema"))
        segments = tuple(SegmentMeta(**s) for s in got.pop("segments"))
        return Manifest(segments=segments, **{k: tuple(v) if isinstance(v, list) else v for k, v in got.items()}), schema

    def publish(self, manifest: Manifest, schema: Schema) -> None:
        self._put(f"manifests/{manifest.version}.json", json.dumps(asdict(manifest) | {"schema": schema.to_json()}))

    # tables
    def table(self, name: str, segments: list[int], schema: str) -> DataFrame:
        """The rows of some segments; only their folders are read."""
        if not segments:
            return empty(self.spark, schema)
        folders = [f"{self.path}/{name}/segment_id={s}" for s in segments]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*folders)

    def deletes(self, manifest: Manifest) -> DataFrame:
        if not manifest.delete_versions:
            return empty(self.spark, DELETES)
        return self.spark.read.schema(DELETES).parquet(*[f"{self.path}/deletes/version={v}" for v in manifest.delete_versions]).distinct()
