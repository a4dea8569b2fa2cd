"""Toxicity filter, quality filter, near-duplicate removal, source mix and packing of ``documents``, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm.common import prepare, shared_folder
from skerry.llm.jaccard import keep_one_of_each
from skerry.llm.mixing import take_mix
from skerry.llm.packing import pack_documents
from skerry.llm.quality import reject_poor
from skerry.llm.toxicity import reject_toxic

#: Each takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("toxicity", reject_toxic),
    ("quality rules", reject_poor),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing sources to target weights", take_mix),
    ("best-fit packing", pack_documents),
]

#: No SQL can express the fitted models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; each result is written to the shared folder and read again as the next input."""
    import uuid

    prepare(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
