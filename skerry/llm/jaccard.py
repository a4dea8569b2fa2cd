"""N-gram Jaccard join by a count-vector R-tree.

A text's shingles are hashed into groups. Its counts by group are a point, and two texts share no more shingles
than the sum over the groups of the smaller count; an R-tree over the points prunes by that bound, and what it
leaves is verified on the shingles themselves. Larger sets have more coordinates, so that the bound tells unlike sets
of any size apart.

The tree is spread over the cluster by its top level. Two sets that are similar enough differ in a bounded number of
shingles, so when shingles are dealt into more groups than that by hash, some group has the same content in both.
Sets that agree on a group's content meet; meetings of the same sets count once. There are more groups than needed, and
a set leaves out as many contents: the first by an order that is the same for all sets, in which those that a sample finds
in many sets come first. So what unlike texts have in common doesn't bring them together, and the sample decides
on the work only, never on the result. Among those that meet, an R-tree finds
which may be similar by the bound. What that connects, directly or through others, is a family, whose pairs are verified
by a tree of its own. Meetings and families of more than ``tile`` sets are cut into tiles by size and hash; only tiles
whose sizes allow similar sets are brought together, two by two: the points of a meeting, and the texts of
a family only where its tiles' own links leave it in pieces. So no pair of similar sets is missed, and no group is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free, fresh, mix64, prepare, table, tidily

#: How many groups there are beyond those needed: at least so many, else that share of the most differences.
SLACK, SLACK_SHARE = 2, 0.5
#: Contents of groups that may be sent to all tasks as frequent, and in how many sets of the sample they are at least.
MOST_FREQUENT, LEAST_SEEN = 100_000, 4
#: Sets of the sample, but at least and at most these shares of all.
SAMPLE, SAMPLE_SHARES = 10_000, (0.01, 0.05)
#: Items whose neighbours are sought before a tree is made.
HUBS = 8
#: Coordinates of a point: powers of two, about a fourth of the set's size, so that unlike sets differ in enough of them.
LEAST_COORDINATES, MOST_COORDINATES = 64, 4096
FANOUT = 32
BLOCK = 1 << 22  # counts compared at once
ROWS_A_PART = 100_000
PARTS_A_BAND = 1 << 24


def shingles(text: str | None, words: int = 3) -> np.ndarray:
    """64-bit hashes of the distinct shingles, rising. Fewer words than a shingle has are one; no words are none."""
    import xxhash

    split = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and spaces only
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    if len(h) < words:
        x = np.full(1, len(h), np.uint64)
        for v in h:
            x = mix64(x * np.uint64(3) + v)
        return x
    n = len(h) - words + 1
    x = mix64(h[:n])
    for k in range(1, words):
        x = mix64(x * np.uint64(2 * k + 1) + h[k : n + k])
    return np.unique(x)


def classes(n: int, percent: int) -> list[tuple[int, int, int]]:
    """For a set of n shingles, the classes of size in which it meets others: (class, most differences, groups).

    A class holds sizes of a ratio below 1.5; a set also takes part in the higher classes whose smallest sets may be
    similar to it. Classes in which similar sets can't differ are left out.
    """
    found, low = [], 1
    k = 0
    while 100 * n >= percent * low:
        high = low + low // 2
        if high >= n:
            most = 2 * high * (100 - percent) // (100 + percent)
            if most:
                found.append((k, most, most + 1 + max(SLACK, int(SLACK_SHARE * most))))
        low, k = high + 1, k + 1
    return found


def signatures(x: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray] | None = None, *, every: bool = False) -> np.ndarray:
    """Hashes of the contents of the set's groups, for each of its classes: one more than similar sets may differ in.

    Similar sets agree on more groups than a set leaves out. It leaves out the first in an order of all contents: empty
    groups, then ``frequent`` ones (rising hashes, and the place of each), then the others by hash. The last
    on which two sets agree has the others before it in both, so neither leaves it out. With ``every``, all contents
    but those of empty groups are returned.
    """
    out = []
    top, spread = x >> np.uint64(32), mix64(x ^ np.uint64(0x5851F42D4C957F2D))
    for k, most, groups in classes(len(x), percent):
        g = (top * np.uint64(groups)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        own = np.uint64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
        full = mix64(np.add.reduceat(spread, first) + mix64(g[first] + own))
        if every:
            out.append(full)
            continue
        leave = groups - most - 1 - (groups - len(first))
        if leave >= 0:
            order = full >> np.uint64(1) | np.uint64(1 << 63)
            if frequent and len(frequent[0]):
                hashes, places = frequent
                at = np.minimum(np.searchsorted(hashes, full), len(hashes) - 1)
                order = np.where(hashes[at] == full, places[at], order)
            out.append(full[np.lexsort((full, order))[leave:]])
        else:
            empty = np.setdiff1d(np.arange(groups, dtype=np.uint64), g[first])
            out += [full, np.sort(mix64(mix64(empty + own) + np.uint64(1)))[leave:]]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def coordinates(n: int) -> int:
    """How many coordinates the point of a set of n shingles has."""
    return min(MOST_COORDINATES, max(LEAST_COORDINATES, 1 << max(0, n // 4 - 1).bit_length()))


def point(x: np.ndarray, dim: int | None = None) -> np.ndarray:
    """Counts of the shingles by group; the groups of fewer coordinates are unions of those of more."""
    dim = dim or coordinates(len(x))
    return np.bincount((x & np.uint64(dim - 1)).astype(np.int64), minlength=dim).astype(np.int32)


def packed(counts: np.ndarray) -> bytes:
    """The bits of a count (4, or 8 or 32 where a count is too large), and the counts."""
    most = int(counts.max())
    if most < 16:
        return b"\4" + (counts[0::2] | counts[1::2] << 4).astype("u1").tobytes()
    return (b"\x08" + counts.astype("u1").tobytes()) if most < 256 else (b"\x20" + counts.astype("<u4").tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    if raw[0] == 4:
        two = np.frombuffer(raw, "u1", offset=1)
        out = np.empty(2 * len(two), np.int32)
        out[0::2], out[1::2] = two & 15, two >> 4
        return out
    return np.frombuffer(raw, "u1" if raw[0] == 8 else "<u4", offset=1).astype(np.int32)


def folded(points: list[np.ndarray]) -> np.ndarray:
    """The points with the coordinates that the smallest of them has."""
    dim = min(map(len, points))
    return np.array([p if len(p) == dim else p.reshape(-1, dim).sum(0) for p in points], dtype=np.int32)


def features(docs: DataFrame, *, id_col: str, text_col: str, percent: int, words: int, sign: bool, frequent=None) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set (null for an empty one), and the set's point or, with ``sign``, its signatures.

    Signatures take about as much room as the texts and are needed once, so they are made where they are shuffled and
    aren't kept with the points. ``frequent`` is a broadcast of what ``signatures`` takes; without it, all signatures are given.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = "signatures" if sign else "point"
        for pdf in frames:
            for at in range(0, len(pdf), 1000):
                ids, rows = pdf.doc_id.iloc[at : at + 1000], []
                for text in pdf.text.iloc[at : at + 1000]:
                    x = shingles(text, words)
                    if len(x):
                        keys = [int(mix64(x ^ np.uint64(s)).sum(dtype=np.uint64).view(np.int64)) for s in (0, 0x1234567)]
                        rows.append((len(x), *keys, signatures(x, percent, frequent and frequent.value, every=not frequent).view(np.int64) if sign else packed(point(x))))
                    else:
                        rows.append((0, None, None, np.zeros(0, np.int64) if sign else b""))
                out = pd.DataFrame(rows, columns=["n_shingles", "k1", "k2", last])
                out["k1"], out["k2"] = pd.array([r[1] for r in rows], "Int64"), pd.array([r[2] for r in rows], "Int64")
                out["doc_id"] = pd.array([None if v is None else int(v) for v in ids], "Int64")
                yield out

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(tidily(run), f"n_shingles long, k1 long, k2 long, {'signatures array<long>' if sign else 'point binary'}, doc_id long")


def _frequent(docs: DataFrame, n: int, options: dict) -> tuple[np.ndarray, np.ndarray]:
    """The contents of groups that most sets of a sample have, as ``signatures`` takes them: at most ``MOST_FREQUENT``.

    Texts are sampled by their hash, so that copies count once.
    """
    least, most = (share * n for share in SAMPLE_SHARES)
    step = int(n / min(max(SAMPLE, least), most)) if n else 1
    some = docs.where(F.pmod(F.xxhash64(F.col(options["text_col"]), F.lit("sample")), F.lit(step)) == 0)
    seen = features(some, **options, sign=True).where("k1 is not null").groupBy("k1", "k2").agg(F.first("signatures").alias("signatures"))
    counts = seen.select(F.explode("signatures").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SEEN)
    top = counts.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).select("s").toPandas()["s"].to_numpy(np.int64).view(np.uint64)  # bounded
    by = np.argsort(top)
    return top[by], by.astype(np.uint64)


def _each(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (a, b) for each pair of columns of each row; how the frame is partitioned stays as it is, so few rows need no shuffle."""
    return df.select(F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])))


def components(edges: DataFrame) -> DataFrame:
    """node and root of each node of the edges (a, b): the smallest node that it is connected with.

    Alternating stars: each node links its larger neighbours, then all its smaller ones, to the smallest of them,
    until nothing changes. Rounds are few (logarithmic in the longest path), each a sum by key and a join.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = e.count()
    while n:
        e = e.coalesce(max(1, n // ROWS_A_PART))  # their number never grows, so neither do the parts
        kids = e.groupBy("a").agg(F.count("*").alias("n"))
        # done when every node has one smaller neighbour at most, and none is both above and below another
        if kids.where("n > 1").isEmpty() and e.select(F.col("b").alias("a")).join(kids, "a", "left_semi").isEmpty():
            break
        both = _each(e, ("a", "b"), ("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        e = cut(_each(large.join(low, "a"), ("b", "m"), ("a", "m")).where("a != b").distinct())
        n = e.count()
    return _each(e, ("a", "b"), ("b", "b")).distinct().select(F.col("a").alias("node"), F.col("b").alias("root"))


class Tree:
    """A packed R-tree over count vectors. Nodes keep the largest counts and the smallest size below them."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        # packed by size, and within slices of that by the coordinate that varies most
        order = np.argsort(sizes, kind="stable")
        step = FANOUT * FANOUT
        parts = []
        for at in range(0, len(order), step):
            part = order[at : at + step]
            parts.append(part[np.argsort(vectors[part][:, vectors[part].var(0).argmax()], kind="stable")])
        self.order = np.concatenate(parts) if parts else order
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        self.levels = []
        top, least = self.vectors, self.sizes
        while len(top) > FANOUT:
            cuts = np.arange(0, len(top), FANOUT)
            top, least = np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((top, least))

    def join(self, percent: int) -> np.ndarray:
        """Which pairs of items may be similar by the bound, in the order that the items were given in: leaf by leaf, against the leaves that may hold any."""
        n = len(self.sizes)
        cuts = np.arange(0, n, FANOUT)
        small = self.vectors.astype("u1") if n and self.vectors.max() < 256 else self.vectors
        top, least, most = (f.reduceat(x, cuts) for f, x in ((np.maximum, self.vectors), (np.minimum, self.sizes), (np.maximum, self.sizes))) if n else (self.vectors, self.sizes, self.sizes)
        step = max(1, BLOCK // (FANOUT * FANOUT * max(1, self.vectors.shape[1])))
        near = np.zeros((n, n), bool)
        for a, at in enumerate(cuts):
            own = small[at : at + FANOUT]
            others = a + np.flatnonzero(self._may(top[a], least[a], top[a:], least[a:], percent) & (percent * least[a:] <= 100 * most[a]) & (percent * least[a] <= 100 * most[a:]))
            for k in range(0, len(others), step):
                items = _below(others[k : k + step], n)
                both = np.minimum(own[:, None], small[items]).sum(2, dtype=np.int32)
                near[at : at + FANOUT, items] = (100 + percent) * both >= percent * (self.sizes[at : at + FANOUT, None] + self.sizes[items])
        near |= near.T
        back = np.argsort(self.order)
        return near[np.ix_(back, back)]

    def search(self, vector: np.ndarray, size: int, percent: int, open_: np.ndarray) -> np.ndarray:
        """Items that may be similar by the bound; ``open_`` masks those in question (in the tree's order)."""
        at = None
        for top, least in reversed(self.levels):
            at = np.arange(len(top)) if at is None else _below(at, len(top))
            at = at[self._may(vector, size, top[at], least[at], percent)]
        at = np.arange(len(self.sizes)) if at is None else _below(at, len(self.sizes))
        at = at[open_[at]]
        return at[self._may(vector, size, self.vectors[at], self.sizes[at], percent)]

    @staticmethod
    def _may(vector, size, vectors, sizes, percent):
        # percent of the union at least: the overlap is percent / (100 + percent) of the sizes' sum at least
        return (100 + percent) * np.minimum(vectors, vector).sum(1) >= percent * (sizes + size)


def _below(at: np.ndarray, n: int) -> np.ndarray:
    got = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    return got[got < n]


def link(sets: list[np.ndarray] | None, vectors: np.ndarray, nodes: list[int], known: list[int], tiles: list[int] | None, percent: int) -> list[tuple[int, int]]:
    """Links (larger node, smaller node) that connect what is similar; pairs already connected are passed over.

    ``known`` names the component that an item is in so far. With ``tiles``, items of one tile aren't compared. Without
    ``sets`` the points' bound alone decides.
    """
    n = len(nodes)
    names: dict = {}
    group = np.array([names.setdefault(k, len(names)) for k in known])
    left = len(names)
    if left < 2:
        return []
    sizes = vectors.sum(1)
    if sets is None and tiles is None and (star := _star(vectors, sizes, percent)):
        return [(max(nodes[i], nodes[j]), min(nodes[i], nodes[j])) for i, j in star]
    tree = Tree(vectors, sizes)
    if sets is None and tiles is None:
        return [(max(nodes[i], nodes[j]), min(nodes[i], nodes[j])) for i, j in _stars(tree.join(percent))]
    near = tree.join(percent) if tiles is None else None
    tile = None if tiles is None else np.array(tiles)
    in_tree, tile_in_tree = group[tree.order], None if tile is None else tile[tree.order]
    found = []
    for i in range(n):
        if near is not None:
            may = np.flatnonzero(near[i] & (group != group[i]))
        else:
            open_ = (in_tree != group[i]) & (tile_in_tree != tile[i])
            may = tree.order[tree.search(vectors[i], int(sizes[i]), percent, open_)] if open_.any() else ()
        for j in may:
            if group[j] == group[i] or not sizes[i] or not sizes[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if sets is not None else 0
            if sets is None or 100 * both >= percent * (sizes[i] + sizes[j] - both):
                found.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
                group[group == group[j]] = group[i]
                in_tree = group[tree.order]
                left -= 1
                if left == 1:
                    return found
    return found


def _star(vectors: np.ndarray, sizes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that connect all items with the first, if the neighbours of few items tell so; else none."""
    left, found = np.arange(1, len(sizes)), [0]
    for k in range(HUBS):
        if k == len(found):
            return []
        near = Tree._may(vectors[found[k]], sizes[found[k]], vectors[left], sizes[left], percent)
        found += left[near].tolist()
        left = left[~near]
        if not len(left):
            return [(i, 0) for i in found[1:]]
    return []


def _stars(near: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect what a symmetric matrix connects: each item with the first of its component."""
    left, pairs = np.ones(len(near), bool), []
    for i in range(len(near)):
        if left[i]:
            left[i] = False
            todo = np.flatnonzero(near[i] & left)
            while len(todo):
                left[todo] = False
                pairs += [(i, j) for j in todo.tolist()]
                todo = np.flatnonzero(near[todo].any(0) & left)
    return pairs


def _linker(percent: int, words: int, by: list[str]):
    """Groups of sorted rows (columns ``by``, node, known, tile or -1, text) to the links in each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def done() -> Iterator[pd.DataFrame]:
            if len(held) > 1:
                tiles = None if held[0][2] < 0 else [h[2] for h in held]
                sets = [shingles(h[3], words) for h in held]
                if got := link(sets, folded([point(x) for x in sets]), [h[0] for h in held], [h[1] for h in held], tiles, percent):
                    yield pd.DataFrame(got, columns=["a", "b"])
            held.clear()

        for pdf in frames:
            for row in pdf.itertuples(index=False):
                if (own := row[: len(by)]) != key:
                    yield from done()
                    key = own
                held.append(row[len(by) :])
        yield from done()

    return run


def _meeting(percent: int):
    """Sorted rows (g, t1, t2, rep, tile, point) to links between those of a unit that may be similar by the bound."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, found = None, [], set()

        def done() -> None:
            if len(held) == 2 and held[0][1] < 0:
                (a, _, x), (b, _, y) = held
                if len(x) != len(y):
                    x, y = folded([x, y])
                if (100 + percent) * int(np.minimum(x, y).sum()) >= percent * int(x.sum() + y.sum()):
                    found.add((max(a, b), min(a, b)))
            elif len(held) > 1:
                nodes, tiles = [h[0] for h in held], [h[1] for h in held] if held[0][1] >= 0 else None
                found.update(link(None, folded([h[2] for h in held]), nodes, nodes, tiles, percent))
            held.clear()

        for pdf in frames:
            for g, t1, t2, rep, tile, raw in zip(pdf.g.tolist(), pdf.t1.tolist(), pdf.t2.tolist(), pdf.rep.tolist(), pdf.tile.tolist(), pdf.point, strict=True):
                if (g, t1, t2) != key:
                    done()
                    key = (g, t1, t2)
                held.append((rep, tile, unpacked(raw)))
            if found:
                yield pd.DataFrame(list(found), columns=["a", "b"])
                found.clear()
        done()
        if found:
            yield pd.DataFrame(list(found), columns=["a", "b"])

    return run


def _tiled(rows: DataFrame, group: str, percent: int, tile: int) -> DataFrame:
    """The rows (with n, their set's size) and ``own``, the tile of their group that they are in, and ``others``, the tiles that may hold similar sets.

    Tiles are bands of size, in which similar sets are the same or next to each other, cut by hash. A group of at most
    ``tile`` rows is one tile, 0.
    """
    width = np.log(100 / percent) * 1.0001 if percent < 100 else 1.0
    total = rows.groupBy(group).agg(F.count("*").alias("_total"))
    rows = rows.join(total, group).withColumn("_band", F.when(F.col("_total") <= tile, F.lit(0)).otherwise(F.floor(F.log("n") / width) + 1).cast("long"))
    bands = rows.groupBy(group, "_band").agg(F.ceil(F.count("*") / tile).alias("_tiles"))
    by = Window.partitionBy(group).orderBy("_band")  # a row a band: some dozens a group
    beside = lambda f, step: F.when(f("_band").over(by) == F.col("_band") + step, f("_tiles").over(by)).otherwise(0)
    bands = bands.withColumn("_before", beside(F.lag, -1)).withColumn("_after", beside(F.lead, 1))
    at = lambda band, part: band * PARTS_A_BAND + part
    tiles = lambda step, n: F.transform(F.sequence(F.lit(1), F.col(n)), lambda k: at(F.col("_band") + step, k - 1))
    none = F.array().cast("array<bigint>")
    every = F.concat(*[F.when(F.col(n) > 0, tiles(step, n)).otherwise(none) for step, n in ((-1, "_before"), (0, "_tiles"), (1, "_after"))])
    rows = rows.join(bands, [group, "_band"]).withColumn("own", at(F.col("_band"), F.pmod(F.xxhash64("node"), F.col("_tiles"))))
    return rows.withColumn("others", F.array_remove(every, F.col("own"))).drop("_total", "_band", "_tiles", "_before", "_after")


def _pairs(rows: DataFrame) -> DataFrame:
    """Of tiled rows, each once for each pair of tiles: t1, t2 and tile."""
    two = rows.withColumn("_other", F.explode("others"))
    return two.withColumns({"t1": F.least("own", "_other"), "t2": F.greatest("own", "_other"), "tile": F.col("own")}).drop("own", "others", "_other")


def _selves(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"t1": F.col("own"), "t2": F.col("own"), "tile": F.lit(-1).cast("long")}).drop("own", "others")


def _links(rows: DataFrame, by: list[str], percent: int, words: int) -> DataFrame:
    sorted_ = rows.select(*by, "node", "known", "tile", "text").repartition(*by).sortWithinPartitions(*by, "node")
    return sorted_.mapInPandas(tidily(_linker(percent, words, by)), "a long, b long")


def join_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5, tile: int = 2048) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: classes of documents linked by a Jaccard similarity of ``percent``.

    component_id is the smallest id that links reach, the row's own included. Texts without words (null, empty or
    blank) link with nothing. Rows that share an id are one document for the links; rows without an id link with
    nothing and have a null component. Repeated rows give as many rows. No result is collected.
    """
    spark = docs.sparkSession
    prepare(spark)
    usable_ = "doc_id is not null and k1 is not null"
    options = {"id_col": id_col, "text_col": text_col, "percent": percent, "words": words}
    rows = cut(features(docs, **options, sign=False))
    usable = rows.where(usable_)
    sets = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("point").alias("point"))
    frequent = spark.sparkContext.broadcast(_frequent(docs, rows.count(), options))
    signed = features(docs, **options, sign=True, frequent=frequent).where(usable_).groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("signatures").alias("signatures"))
    by = "over (partition by s)"
    met = signed.select("rep", F.explode("signatures").alias("s")).selectExpr("rep", f"min(rep) {by} as hub", f"max(rep) {by} as last", f"count(*) {by} as n", f"bit_xor(xxhash64(rep)) {by} as x")
    met = cut(met.where("hub != last").select("rep", F.xxhash64("hub", "last", "n", "x").alias("g"), F.col("n").alias("total")).distinct())  # the same sets meet in many groups: once is enough
    free(spark)
    points = met.where(F.col("total") <= tile).select("g", F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), "rep", F.lit(-1).cast("long").alias("tile"))
    many = met.where(F.col("total") > tile).drop("total")
    if not many.isEmpty():
        many = cut(_tiled(many.join(sets.select("rep", "n"), "rep").withColumn("node", F.col("rep")), "g", percent, tile))
        points = points.unionByName(_selves(many).unionByName(_pairs(many)).select("g", "t1", "t2", "rep", "tile"))
    points = points.join(sets.select("rep", "point"), "rep")
    near = points.select("g", "t1", "t2", "rep", "tile", "point").repartition("g", "t1", "t2").sortWithinPartitions("g", "t1", "t2", "rep").mapInPandas(tidily(_meeting(percent)), "a long, b long")
    near = cut(near.distinct())
    free(spark)
    families = components(near).withColumnRenamed("root", "family").join(sets.select(F.col("rep").alias("node"), "n"), "node")
    members = cut(_tiled(families, "family", percent, tile))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    units = ["family", "t1", "t2"]
    links = cut(_links(_selves(members).withColumn("known", F.col("node")).join(texts, "node"), units, percent, words))
    free(spark)
    large = members.where("size(others) > 0")
    if not large.isEmpty():
        # the smallest members of the tiles' components
        state = large.join(components(links), "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root")
        hubs = _selves(_tiled(state.where("known = node").select("family", "node", "n", "known"), "family", percent, tile))
        links = cut(links.unionByName(_links(hubs.join(texts, "node"), units, percent, words)))
        # what is still apart in a family: its tiles, two by two
        state = cut(large.join(components(links), "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root"))
        apart = state.groupBy("family").agg(F.min("known").alias("x"), F.max("known").alias("y")).where("x != y").select("family")
        links = cut(links.unionByName(_links(_pairs(state.join(apart, "family")).join(texts, "node"), units, percent, words)))
    # rows that share an id but not a text connect their classes
    shared = usable.groupBy("doc_id").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).where("x != y")
    same_id = usable.join(shared, "doc_id", "left_semi").join(sets.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links.unionByName(same_id))
    classes_ = sets.select("k1", "k2", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("least"))
    result = rows.select("doc_id", "n_shingles", "k1", "k2").join(classes_, ["k1", "k2"], "left")
    return result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"), percent=90, words=3)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str, *, percent: int = 80, words: int = 5) -> DataFrame:
    """One document of each class, the one of the smallest id, with its columns; rows without an id all stay.

    Rows that share an id and a text are one document, of which the row that sorts first by hash stays. Texts without
    words are in no class but their own. Rows that share an id but not a text are in one class, as their id is; the
    first of them by the text's hash stays for it, the same in each run. An empty table gives no rows.
    """
    classes_ = join_similar(docs, percent=percent, words=words)
    key, place = fresh(docs, "kept_id"), fresh(docs, "kept_place")
    kept = classes_.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    chosen = docs.join(kept, F.col("doc_id") == F.col(key), "left_semi")
    # a window only over ids that several rows have: whole rows aren't shuffled for the rest
    again = chosen.groupBy("doc_id").agg(F.count("*").alias(place)).where(F.col(place) > 1).select(F.col("doc_id").alias(key))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*docs.columns)))
    several = chosen.join(again, F.col("doc_id") == F.col(key), "left_semi").withColumn(place, first).where(F.col(place) == 1).drop(place)
    single = chosen.join(again, F.col("doc_id") == F.col(key), "left_anti")
    return single.unionByName(several).unionByName(docs.where(F.col("doc_id").isNull()))
