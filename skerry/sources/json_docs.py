"""Documents from JSON arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The keys of an imported document, what stands for a missing title and category, and the first id.
KEYS = ("title", "content", "url", "site", "author", "timestamp", "description", "category")
UNTITLED, GENERAL, FIRST_ID = "Untitled", "General", 10_000


def import_json(spark: SparkSession, path: str, *, first_id: int = FIRST_ID) -> DataFrame:
    """doc_id and the known keys of each object of JSON arrays; objects without title and content are left out.

    Ids count on from ``first_id`` in the order of the files and objects: by sums over the partitions read, so the
    rows needn't meet in one task.
    """
    rows = spark.read.schema(", ".join(f"{k} string" for k in KEYS)).option("multiLine", True).json(path)
    rows = rows.where("nvl(title, '') != '' or nvl(content, '') != ''").withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))  # a row a partition
    within = Window.partitionBy("_part").orderBy("_at")
    rows = rows.withColumn("_part", part).withColumn("_k", F.row_number().over(within) - 1).join(F.broadcast(firsts), "_part")
    text = {"title": F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)), "category": F.coalesce(F.nullif("category", F.lit("")), F.lit(GENERAL))}
    return rows.select((F.col("_k") + F.col("_first") + first_id).cast("string").alias("doc_id"), *[text.get(k, F.coalesce(k, F.lit(""))).alias(k) for k in KEYS])
