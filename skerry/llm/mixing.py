"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slot t of the schedule is the van der Corput point of t (its binary digits reversed); where the point falls in the
sources' cumulative weights says whose turn it is. With a power of two of slots, every source gets exactly its
number of them, spread evenly over any stretch. A source's slots are ranked, and the r-th takes the r-th block of
the source's shuffled documents laid end to end, all blocks of the same number of words, starting again at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORDS, cut, fresh, prepare, table

# The weights that sources get in turn, the share of all sizes that is taken, and the most of a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_TIMES = 2


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """source, source_size, target: a row a source of a frame with source and size.

    Sources in the order of their code points, null last, have the weights in turn. All targets add up to ``share`` of all
    sizes; a target is its weight times one level for all sources, or ``most`` times the source's size where that is
    less. The level is found over the sources in the order in which they reach their limits.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    full = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    # the level if exactly the sources before this one were at their limits
    by = by.withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level"))).over(every)
    return by.withColumn("level", level).select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("w"))).alias("target"))


def _beside(side: DataFrame, rows: int) -> DataFrame:
    """A join side of a row a source or so: broadcast while it is small, else left to a shuffled join."""
    return F.broadcast(side) if rows <= 100_000 else side


def schedule(plan: DataFrame, block: int, bits: int) -> DataFrame:
    """source_no, rank, slot: the slots of each source in turn, ranked from 0.

    Of a frame with source_no, first and slots, the place of a source's share among ``2 ** bits`` and its length; points
    beyond all shares are idle. Ranks are sums over chunks of the schedule, then counts within a chunk, so that no
    source's slots are one task's work.
    """
    spark = plan.sparkSession
    chunk = 1 << 12
    t = spark.range(0, 1 << bits).withColumnRenamed("id", "slot")
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")
    # a share holds whole cells of a grid, or parts of its first and last; the grid makes the lookup a join by key
    cell = max(0, bits - 12)
    cells = plan.where("slots > 0").select("source_no", "first", "slots", F.explode(F.sequence(F.expr(f"shiftright(first, {cell})"), F.expr(f"shiftright(first + slots - 1, {cell})"))).alias("cell"))
    points = t.withColumn("point", point).withColumn("cell", F.expr(f"shiftright(point, {cell})"))
    turn = points.join(_beside(cells, plan.count() + (1 << 12)), "cell").where("point >= first and point < first + slots").select("source_no", "slot", F.floor(F.col("slot") / chunk).alias("chunk"))
    counts = turn.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "chunk").orderBy("slot")
    return turn.withColumn("k", F.row_number().over(within) - 1).join(firsts, ["source_no", "chunk"]).select("source_no", (F.col("k") + F.col("base")).alias("rank"), "slot")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 4096, least_blocks: int = 1 << 14, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, size, source_size, target, taken) and the mix (slot, source, doc_id, start, words, epoch).

    A row of the mix is the part of a document that a slot takes: ``words`` words from its ``start``-th on. ``taken`` is
    the number of words that all slots take of a document. A block has at most ``block_words`` words, and fewer where the
    mix would have less than ``least_blocks`` blocks. Documents are shuffled within their source by a hash of their id and
    text, so reruns agree. Null sources are a source of their own; documents without words are never taken. Rows that
    are alike in id and text are told apart by nothing: each gets the mean of what they take, to the next word.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), id_col, text_col).alias("h"))
    rows = cut(rows)
    plan = cut(targets(rows, weights=weights, share=share, most=most))
    total, n_sources = plan.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0)), F.count("*")).first()
    n_rows = rows.count()
    block = max(1, min(block_words, int(total) // least_blocks))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    plan = plan.withColumn("words", F.floor(F.col("target") + 1e-6).cast("long")).withColumn("slots", F.ceil(F.col("words") / block).cast("long"))
    plan = plan.withColumn("source_no", F.row_number().over(in_order)).withColumn("first", F.coalesce(F.sum("slots").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = cut(plan)
    slots = plan.agg(F.sum("slots")).first()[0] or 0
    bits = max(0, int(slots - 1).bit_length()) if slots else 0

    # a document's place in its source: sums over ranges of the hash, then within one
    parts = max(1, n_rows // 2000)
    part = F.pmod(F.shiftright("h", 20), F.lit(parts))
    rows = rows.join(_beside(plan.select(F.col("source").alias("s"), "source_no", "source_size", "target", F.col("words").alias("limit")), n_sources), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("part", part)
    before = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("source_no", "part").agg(F.sum("size").alias("n")).select("source_no", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("k", F.coalesce(F.sum("size").over(within), F.lit(0))).join(firsts, ["source_no", "part"]).withColumn("at", F.col("k") + F.col("base"))

    # its stretches of the source, once an epoch, cut at the blocks' edges
    epochs = F.sequence(F.lit(0), F.lit(most - 1))
    stretch = placed.select("doc_id", "h", "source", "source_no", "size", "source_size", "limit", "at", F.explode(epochs).alias("epoch"))
    stretch = stretch.withColumn("lo", F.col("at") + F.col("epoch") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("limit"))).where("hi > lo")
    stretch = stretch.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    stretch = stretch.withColumn("from", F.greatest("lo", F.col("rank") * block)).withColumn("words", F.least("hi", (F.col("rank") + 1) * block) - F.col("from"))
    taken_parts = stretch.join(schedule(plan, block, bits), ["source_no", "rank"])
    mixed = taken_parts.select("slot", "source", "doc_id", (F.col("from") - F.col("lo")).alias("start"), "words", "epoch", "h", "source_no")
    taken = mixed.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("source_no").alias("no")).agg(F.sum("words").alias("words"))
    alike = Window.partitionBy("doc_id", "h", "source_no")
    out = placed.withColumn("alike", F.count("*").over(alike)).join(taken, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("source_no") == F.col("no")), "left")
    out = out.select("doc_id", "h", "source", "size", "source_size", "target", F.coalesce(F.ceil(F.col("words") / F.col("alike")), F.lit(0)).cast("long").alias("taken"))
    return out, mixed.drop("h", "source_no")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = mix(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "size", "source_size", "target", "taken")


def take_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their columns as they were: as often as it takes them, to the nearest whole time."""
    chosen, _ = mix(docs)
    h, times = fresh(docs, "h"), fresh(docs, "times")
    key = fresh(docs, "key")
    chosen = chosen.groupBy(F.col("doc_id").alias(key), F.col("h").alias(h), F.col("source").alias(fresh(docs, "s"))).agg(F.round(F.max("taken") / F.max(F.greatest("size", F.lit(1)))).cast("int").alias(times)).where(F.col(times) > 0)
    own = docs.withColumn(fresh(docs, "own"), F.xxhash64(F.lit(11), "doc_id", "text"))
    same = F.col(fresh(docs, "own")) == F.col(h)
    same &= own["doc_id"].eqNullSafe(F.col(key)) & own["source"].eqNullSafe(F.col(fresh(docs, "s")))
    return own.join(chosen, same).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[own[c] for c in docs.columns])
