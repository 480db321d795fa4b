"""Hard negatives by vantage-point trees over norm-augmented vectors.

With M the largest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0). All rows then have norm M and
distance^2 = |q|^2 + M^2 - 2 q.x, so a window of inner products is an annulus of distances and the highest score is the nearest row.

An upper tree, fit on a bounded sample, deals every row to a cell; a cell of any size is cut into blocks by a hash of the row, and each block is
a tree of its own with the exact range of distances to the vantage points of every leaf. Queries visit the blocks whose cells their annulus
meets. Within a block, leaves are taken nearest first, each query's as many at a time as the step before and once more, until k rows are
nearer than all leaves that are left. Distances only steer; scores are exact integers, and bounds carry a margin for rounding, so nothing is missed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneatlas.session import ship

from .common import remove, shared_dir, written

#: Share of the largest norm by which every distance bound is widened.
MARGIN = 1e-6
#: Larger components than this (of the scaled vectors) are cut to it, so that scores of up to 2000 components fit a long.
LARGEST = 1 << 26
#: Rows of a leaf within a block.
LEAF = 128
#: Queries that search a block together.
TOGETHER = 512


# --- vantage-point trees ---------------------------------------------------------------------------------------------------------------------


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with one component more, so that all have the norm whose square is `top`."""
    return np.hstack([x, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0.0))[:, None]])


def distances(x: np.ndarray, v: np.ndarray, top: float, other: np.ndarray | float | None = None) -> np.ndarray:
    """Distances of rows of x, of squared norm `other` (default: top), to the vantage points v of squared norm `top`."""
    own = top if other is None else other
    return np.sqrt(np.maximum(top + own - 2.0 * (x @ v.T), 0.0))


def grow(x: np.ndarray, top: float, leaf: int) -> tuple[list, list]:
    """(nodes, leaves) of a tree over augmented rows. A node is (vantage row, threshold, near child, far child); children below zero are leaves, ~number.
    The vantage point is the row farthest from the node's first one; rows nearer than the median distance go left, ties with it right, unless all tie."""
    nodes: list = []
    leaves: list = []

    def build(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            far = rows[int(np.argmax(distances(x[rows], x[rows[:1]], top)[:, 0]))]
            d = distances(x[rows], x[far][None], top)[:, 0]
            cut = float(np.median(d))
            near = d < cut
            if not near.any():
                cut = float(np.nextafter(cut, np.inf))
                near = d < cut
            if near.any() and not near.all():
                at = len(nodes)
                nodes.append(None)
                nodes[at] = (int(far), cut, build(rows[near]), build(rows[~near]))
                return at
        leaves.append(rows)
        return ~(len(leaves) - 1)

    root = build(np.arange(len(x)))
    if root < 0:
        nodes = []
    return nodes, leaves


def paths(nodes: list, leaves: int) -> list[list[tuple[int, bool]]]:
    """For each leaf the (node, is near) on its way."""
    out: list[list[tuple[int, bool]]] = [[] for _ in range(leaves)]

    def walk(at: int, way: list[tuple[int, bool]]) -> None:
        if at < 0:
            out[~at] = way
        else:
            walk(nodes[at][2], [*way, (at, True)])
            walk(nodes[at][3], [*way, (at, False)])

    if nodes:
        walk(0, [])
    return out


class Cells:
    """The upper tree: where rows go, and how near and how far from a query each cell's rows can be."""

    def __init__(self, sample: np.ndarray, top: float, cells: int) -> None:
        self.top, width = top, sample.shape[1] if len(sample) else 0
        x = augmented(sample, top) if len(sample) else np.zeros((0, width + 1))
        nodes, leaves = grow(x, top, max(2, -(-len(x) // max(cells, 1)))) if len(x) else ([], [np.zeros(0, int)])
        self.vantage = x[[n[0] for n in nodes]] if nodes else np.zeros((0, x.shape[1]))
        self.cut = np.array([n[1] for n in nodes])
        self.child = np.array([n[2:] for n in nodes], int).reshape(-1, 2)
        self.ways = paths(nodes, len(leaves))
        self.n = len(leaves)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        at = np.zeros(len(x), int)
        if not len(self.cut):
            return at
        a = augmented(x, self.top)
        while (on := np.flatnonzero(at >= 0)).size:
            node = at[on]
            for k in np.unique(node):
                own = on[node == k]
                near = distances(a[own], self.vantage[k][None], self.top)[:, 0] < self.cut[k]
                at[own] = np.where(near, self.child[k, 0], self.child[k, 1])
        return ~at

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) distance of each query to the rows of each cell, as far as the thresholds tell."""
        norm = np.einsum("ij,ij->i", q, q)
        slack = MARGIN * np.sqrt(self.top)
        lo, hi = np.zeros((len(q), self.n)), np.tile((np.sqrt(norm) + np.sqrt(self.top))[:, None], (1, self.n))
        if len(self.cut):
            d = distances(np.hstack([q, np.zeros((len(q), 1))]), self.vantage, self.top, norm[:, None])
            for c, way in enumerate(self.ways):
                for k, near in way:
                    if near:
                        lo[:, c] = np.maximum(lo[:, c], d[:, k] - self.cut[k])
                        hi[:, c] = np.minimum(hi[:, c], d[:, k] + self.cut[k])
                    else:
                        lo[:, c] = np.maximum(lo[:, c], self.cut[k] - d[:, k])
        return lo - slack, hi + slack


class Block:
    """A tree over the rows of one block, with the range of distances to each vantage point on a leaf's way."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, top: float) -> None:
        a = augmented(x, top)
        nodes, leaves = grow(a, top, LEAF)
        order = np.concatenate(leaves) if leaves else np.zeros(0, int)
        self.top, self.ids, self.labels, self.x = top, ids[order], labels[order], _narrow(x[order])
        self.starts = np.cumsum([0] + [len(r) for r in leaves])
        self.vantage = a[[n[0] for n in nodes]] if nodes else np.zeros((0, a.shape[1]))
        self.ways = []
        for rows, way in zip(leaves, paths(nodes, len(leaves)), strict=True):
            at = [k for k, _ in way]
            d = distances(a[rows], self.vantage[at], top) if at else np.zeros((len(rows), 0))
            self.ways.append((at, d.min(0), d.max(0)))

    def bounds(self, q: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slack = MARGIN * np.sqrt(self.top)
        lo, hi = np.zeros((len(q), len(self.ways))), np.tile((np.sqrt(norm) + np.sqrt(self.top))[:, None], (1, len(self.ways)))
        if len(self.vantage):
            d = distances(np.hstack([q, np.zeros((len(q), 1))]), self.vantage, self.top, norm[:, None])
            for c, (at, a, b) in enumerate(self.ways):
                if at:
                    lo[:, c] = np.maximum(d[:, at] - b, a - d[:, at]).max(1)
                    hi[:, c] = (d[:, at] + b).min(1)
        return np.maximum(lo, 0.0) - slack, hi + slack

    def nearest(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, least: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score): for each query and window w, numbered query * windows + w, the k rows of highest score in least..most, ties by smaller
        id, of the query's label (same; without the query's own row) or of any other. `least` and `most` are queries x windows."""
        n, windows = least.shape
        norm = np.einsum("ij,ij->i", q, q)
        lo, hi = self.bounds(q, norm)
        # a window of scores as an annulus of distances, widened as the bounds are
        reach = lambda s: np.sqrt(np.maximum(norm[:, None] + self.top - 2.0 * s.astype(float), 0.0))
        slack = 2 * MARGIN * np.sqrt(self.top)
        inner, outer = reach(most) - slack, reach(least) + slack
        first, last = inner.min(1), outer.max(1)
        open_ = (lo <= last[:, None]) & (hi >= first[:, None])
        order = np.argsort(np.where(open_, np.maximum(lo, first[:, None]), np.inf), axis=1, kind="stable")
        left = open_.sum(1)
        floor = least.copy()  # rises to the k-th best score found
        found = [np.zeros(0, np.int64)] * 3
        whole = _whole(q, self.x)
        at, step = 0, 1
        while at < left.max(initial=0):
            take = order[:, at : at + step]
            rank = np.arange(at, at + take.shape[1])
            limit = reach(floor).max(1) + slack
            go = (rank[None, :] < left[:, None]) & (np.take_along_axis(lo, take, 1) <= limit[:, None])
            who, col = np.nonzero(go)
            leaf = take[who, col]
            by = np.argsort(leaf, kind="stable")
            who, leaf = who[by], leaf[by]
            new = [found]
            cuts = np.flatnonzero(np.diff(leaf)) + 1
            for part, c in zip(np.split(who, cuts), leaf[np.concatenate([[0], cuts])] if len(leaf) else [], strict=False):
                a, b = self.starts[c], self.starts[c + 1]
                s = _scores(q[part], self.x[a:b], whole)
                fit = self.labels[a:b][None, :] == labels[part][:, None]
                fit = fit & (self.ids[a:b][None, :] != ids[part][:, None]) if same else ~fit
                for w in range(windows):
                    i, j = np.nonzero(fit & (s >= floor[part, w][:, None]) & (s <= most[part, w][:, None]))
                    if i.size:
                        new.append([part[i] * windows + w, a + j, s[i, j]])
            found = self._best([np.concatenate(c) for c in zip(*new, strict=True)], k)
            full = np.flatnonzero(np.bincount(found[0], minlength=n * windows) >= k)
            if full.size:
                ends = np.searchsorted(found[0], full, side="right") - 1
                floor.reshape(-1)[full] = found[2][ends]
            at += step
            step *= 2
        return found[0], found[1], found[2]

    def _best(self, found: list[np.ndarray], k: int) -> list[np.ndarray]:
        by = np.lexsort((self.ids[found[1]], -found[2], found[0]))
        found = [c[by] for c in found]
        starts = np.flatnonzero(np.diff(found[0], prepend=-1))
        rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
        return [c[rank < k] for c in found]


def _narrow(x: np.ndarray) -> np.ndarray:
    small = x.size == 0 or np.abs(x).max() < 1 << 15
    return x.astype(np.int16 if small else np.int32)


def _whole(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether sums of products stay exact in doubles."""
    size = float(np.abs(q).max(initial=0)) * float(np.abs(x.astype(np.int64)).max(initial=0)) * max(q.shape[1], 1)
    return size < 1 << 52


def _scores(q: np.ndarray, x: np.ndarray, whole: bool) -> np.ndarray:
    if whole:
        return (q @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


# --- on Spark --------------------------------------------------------------------------------------------------------------------------------


def scaled(embedding: Column | str, factor: int = 256) -> Column:
    """floor(factor * x) of each component, within LARGEST."""
    return F.transform(embedding, lambda x: F.least(F.lit(LARGEST), F.greatest(F.lit(-LARGEST), F.floor(x.cast("double") * factor))).cast("int"))


def vectors(rows: DataFrame, label: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, label, v of the rows that take part; of several rows with one id the one of the smallest label, then vector, stays."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    out = rows.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
    out = out.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), scaled(embedding).alias("v")).where("label is not null")
    n, distinct = out.agg(F.count("*"), F.countDistinct("id")).first()
    if n != distinct:
        out = out.groupBy("id").agg(F.min(F.struct("label", "v")).alias("s")).select("id", "s.label", "s.v")
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of doubles, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.asarray(column.flatten(), dtype=np.float64)
    return out


def hard_negatives(
    rows: DataFrame, label: Column | str = "label", anchor: Column | str | None = None, positives: int = 5, k: int = 3, least: int = 50, most: int = 95,
    vec_id: str = "vec_id", embedding: str = "embedding", block: int = 16384, sample: int = 4096, queries: int = 8192,
) -> DataFrame:
    """For each anchor and each of its first `positives` rows of the same label, the first k rows of other labels whose score is in least..most per cent
    of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score (higher first, ties by smaller id).

    `anchor` tells on the columns id and label which rows are anchors. Rows with a null id or label, or with a null vector or component, or one that is not finite, take
    no part; repeated ids count once; shorter vectors are filled up with zeros (an empty one scores 0). Further columns are ignored. An empty
    table, or one without anchors, gives an empty result. Results are exact: `block` (rows of a block), `sample` (rows the upper tree is fit on) and
    `queries` (anchors that meet a block in one task) only steer. Anchors and blocks meet as groups of both, never as rows with rows, and a
    block that an anchor's annulus cannot meet is not visited.
    """
    spark = rows.sparkSession
    ship(spark)
    places: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        places.append(shared_dir(spark))
        return written(df, places[-1])

    label = F.col(label) if isinstance(label, str) else label
    anchor = F.expr(anchor) if isinstance(anchor, str) else F.lit(True) if anchor is None else anchor
    table = kept(vectors(rows, label, vec_id, embedding))
    n, width, top = table.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    if not n:
        return spark.createDataFrame([], FOUND)
    width, top = width or 0, float(top or 0.0)
    picked = table.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()  # bounded by `sample`
    cells = Cells(_matrix(picked.column("v"), width), top, min(-(-n // block), max(1, sample // 32)))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.route(_matrix(b.column(2), width)), pa.int32())], names=["id", "label", "v", "cell"])

    table = kept(table.mapInArrow(routed, "id long, label long, v array<int>, cell int"))
    counts = table.groupBy("cell").count().collect()  # one row a cell, at most sample / 32
    shards = {r[0]: -(-r[1] // block) for r in counts}
    first, blocks = {}, 0
    for c in sorted(shards):
        first[c], blocks = blocks, blocks + shards[c]
    deal = spark.createDataFrame([(c, first[c], shards[c]) for c in shards], "cell int, first long, shards int")
    dealt = table.join(F.broadcast(deal), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64(F.lit(11), "id"), F.col("shards")))

    def packed(part: pa.Table) -> pa.Table:
        made = Block(np.asarray(part.column("id")), np.asarray(part.column("label")), _matrix(part.column("v"), width), top)
        return pa.table({"block": part.column("block")[:1], "tree": pa.array([pickle.dumps(made, protocol=5)], pa.binary())})

    trees = kept(dealt.select("block", "id", "label", "v").groupBy("block").applyInArrow(packed, "block long, tree binary"))
    asked = kept(table.where(anchor).select("id", "label", "v", "cell"))
    chunks = max(1, -(-asked.count() // queries))
    spread = F.pmod(F.xxhash64(F.lit(12), "id"), F.lit(chunks))

    def visits(scope: str):
        """Rows (id, label, v, cell, w) to (block, chunk, ...) for the cells whose distances can meet the windows w. scope: home, others or all cells."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slack = 2 * MARGIN * np.sqrt(top)
            starts = np.array([first.get(c, 0) for c in range(cells.n)])
            number = np.array([shards.get(c, 0) for c in range(cells.n)])
            for b in batches:
                for at in range(0, b.num_rows, TOGETHER):
                    part = b.slice(at, TOGETHER)
                    q, home = _matrix(part.column(2), width), np.asarray(part.column(3))
                    low, high = _matrix(part.column(4), positives), _matrix(part.column(5), positives)
                    lo, hi = cells.bounds(q)
                    norm = np.einsum("ij,ij->i", q, q)
                    count = np.asarray(part.column(4).value_lengths())
                    no = np.arange(positives)[None, :] >= count[:, None]
                    far = lambda s: np.sqrt(np.maximum(norm[:, None] + top - 2.0 * s, 0.0))
                    inner = np.where(no, np.inf, far(high)).min(1) - slack
                    outer = np.where(no, -np.inf, far(low)).max(1) + slack
                    go = (lo <= outer[:, None]) & (hi >= inner[:, None]) & (number > 0)[None, :]
                    own = np.arange(cells.n)[None, :] == home[:, None]
                    go &= own if scope == "home" else ~own if scope == "others" else True
                    i, c = np.nonzero(go)
                    times = number[c]
                    i, c = np.repeat(i, times), np.repeat(c, times)
                    nth = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                    out = part.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([pa.array(starts[c] + nth, pa.int64()), *out.columns], names=["block", *out.schema.names])

        return run

    def meeting(windows: DataFrame, scope: str, same: bool, take: int) -> DataFrame:
        """(id, window, other, score) of the best of each block."""
        on = windows.select("id", "label", "v", "cell", "least", "most").mapInArrow(visits(scope), "block long, id long, label long, v array<int>, cell int, least array<long>, most array<long>")
        on = kept(on.withColumn("chunk", spread))
        pairs = spark.read.parquet(places[-1]).select("block", "chunk").distinct()
        left = trees.join(pairs, "block")

        def search(tree: pa.Table, part: pa.Table) -> pa.Table:
            names = ["id", "window", "other", "score"]
            if not tree.num_rows or not part.num_rows:
                return pa.table([pa.array([], pa.int64())] * 4, names=names)
            own = pickle.loads(tree.column("tree")[0].as_py())
            outs: list[list[np.ndarray]] = [[], [], [], []]
            for at in range(0, part.num_rows, TOGETHER):
                p = part.slice(at, TOGETHER)
                ids = np.asarray(p.column("id"))
                low, high = p.column("least").combine_chunks(), p.column("most").combine_chunks()
                count = np.asarray(low.value_lengths())
                wide = int(count.max(initial=0))
                held = np.arange(wide)[None, :] < count[:, None]
                a, b = np.full(held.shape, 1, np.int64), np.zeros(held.shape, np.int64)  # no row fits a window from 1 to 0
                a[held], b[held] = np.asarray(low.flatten()), np.asarray(high.flatten())
                who, row, score = own.nearest(_matrix(p.column("v"), width), ids, np.asarray(p.column("label")), same, a, b, take)
                for c, x in zip(outs, (ids[who // wide], who % wide, own.ids[row], score), strict=True):
                    c.append(x)
            return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in outs], names=names)

        return left.groupBy("block", "chunk").cogroup(on.groupBy("block", "chunk")).applyInArrow(search, "id long, window long, other long, score long")

    def best(found: DataFrame, take: int) -> DataFrame:
        """The first `take` of each anchor and window, over at most `take` from each block."""
        order = Window.partitionBy("id", "window").orderBy(F.desc("score"), "other")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)

    wide = 1 << 62
    every = asked.withColumn("least", F.array(F.lit(-wide))).withColumn("most", F.array(F.lit(wide)))
    near = kept(best(meeting(every, "home", True, positives), positives))
    bound = near.groupBy("id").agg(F.count("*").alias("c"), F.min("score").alias("s"))
    rest = asked.join(bound, "id", "left").withColumn("least", F.array(F.when(F.col("c") == positives, F.col("s")).otherwise(F.lit(-wide))))
    rest = meeting(rest.withColumn("most", F.array(F.lit(wide))), "others", True, positives)
    chosen = kept(best(near.drop("rank").unionByName(rest), positives))
    # whole numbers with least * positive <= 100 * score <= most * positive
    low = F.expr(f"cast(-floor(-(cast(score as decimal(20, 0)) * {least}) / 100) as long)").alias("a")
    high = F.expr(f"cast(floor(cast(score as decimal(20, 0)) * {most} / 100) as long)").alias("b")
    windows = chosen.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", low, high))).alias("w"))  # `positives` rows an anchor
    windows = asked.join(windows.select("id", F.col("w.a").alias("least"), F.col("w.b").alias("most")), "id")
    negatives = best(meeting(windows, "all", False, k), k)
    pairs = chosen.select("id", (F.col("rank") - 1).cast("long").alias("window"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(pairs, ["id", "window"]).select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = written(out)
    for path in places:
        remove(spark, path)
    return out


FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
