"""Operator 13: hard negatives from vantage-point trees over norm-augmented vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlake.functions.ordered import checkpointed
from strandlake.llm.exchange import partitions
from strandlake.llm.kernels import pack, thrifty_pair, unpack

#: Rows of a leaf at least, leaves of a tree at most, and anchors that one task holds.
LEAF, LEAVES, ANCHORS = 64, 512, 1 << 14
#: Columns of the rows: id, label, integer vector.
_ROWS = ("_id", "_label", "_vector")


class VantageTree:
    """A vantage-point tree over vectors that one more coordinate brings to one norm.

    With x' = (x, sqrt(M^2 - |x|^2)) and an anchor q' = (q, 0), the squared distance
    |q' - x'|^2 is |q|^2 + M^2 - 2 q.x: nearer means a higher inner product, and a
    window of scores is an annulus around the anchor.  A node splits its rows at the
    median of their distances from a row of its own, and each side knows the least
    and the greatest of them.  Rows stand in order of id, so a place tells which of
    two ids is smaller.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        square = (self.vectors**2).sum(1)
        self.top = float(square.max()) if len(ids) else 0.0
        points = np.concatenate([self.vectors, np.sqrt(self.top - square)[:, None]], axis=1)
        least = max(LEAF, -(-len(ids) // LEAVES))
        self.leaves: list[np.ndarray] = []
        # For each leaf the vantage rows above it, with the distances between which its rows lie.
        paths: list[list[tuple[int, float, float]]] = []
        stack = [(np.arange(len(ids)), [])] if len(ids) else []
        while stack:
            rows, path = stack.pop()
            if len(rows) <= least:
                self.leaves.append(rows)
                paths.append(path)
                continue
            # The row farthest from the first one sees the others at the most different distances.
            far = rows[np.linalg.norm(points[rows] - points[rows[0]], axis=1).argmax()]
            distance = np.linalg.norm(points[rows] - points[far], axis=1)
            near = np.argsort(distance, kind="stable")
            for half in (near[len(near) // 2 :], near[: len(near) // 2]):
                stack.append((np.sort(rows[half]), [*path, (int(far), float(distance[half].min()), float(distance[half].max()))]))
        depth = max(map(len, paths), default=0)
        self.vantage = np.zeros((len(paths), depth), np.int64)
        self.low, self.high = np.zeros((len(paths), depth)), np.full((len(paths), depth), np.inf)
        for k, path in enumerate(paths):
            for j, (row, low, high) in enumerate(path):
                self.vantage[k, j], self.low[k, j], self.high[k, j] = row, low, high
        self.visited = self.skipped = 0

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that a row of each leaf can have, by anchor and leaf, by the triangle inequality."""
        shape = (len(anchors), len(self.leaves))
        norm = (anchors**2).sum(1)
        used, place = np.unique(self.vantage, return_inverse=True)
        place = place.reshape(self.vantage.shape)
        squared = norm[:, None] + self.top - 2 * (anchors @ self.vectors[used].T)
        seen = np.sqrt(np.maximum(squared, 0))
        nearest, farthest = np.zeros(shape), np.full(shape, np.inf)
        for j in range(self.vantage.shape[1]):
            d = seen[:, place[:, j]]
            np.maximum(nearest, np.maximum(d - self.high[:, j], self.low[:, j] - d), out=nearest)
            np.minimum(farthest, d + self.high[:, j], out=farthest)
        reach = norm[:, None] + self.top
        # A little slack keeps rounding in the distances from costing a row; a score is exact.
        slack = 1 + 1e-6 * reach
        return (reach - farthest**2) / 2 - slack, (reach - nearest**2) / 2 + slack

    def search(self, anchors: np.ndarray, allowed, windows: tuple[np.ndarray, np.ndarray], owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score): the k best rows of each query, best first, ties by smaller id.

        Query i asks for rows of anchor ``owner[i]`` (rising) with a score from
        ``windows[0][i]`` to ``windows[1][i]``; ``allowed(anchors, rows)`` is a matrix.
        Leaves are entered nearest first from the near edge of the annulus, each by all
        anchors whose turn it is, until no leaf left can better a query's k-th row.
        """
        floor, ceiling = windows
        n, empty = len(owner), -np.iinfo(np.int64).max
        score, row = np.full((n, k), empty, np.int64), np.full((n, k), -1, np.int64)
        if not len(self.leaves) or not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        least, most = self.bounds(anchors)
        highest = np.full(len(anchors), -np.inf)
        np.maximum.at(highest, owner, ceiling.astype(float))
        turn = np.argsort(-np.minimum(most, highest[:, None]), axis=1, kind="stable")
        live = np.ones(n, bool)
        for r in range(len(self.leaves)):
            leaf = turn[:, r][owner]
            # What is left is farther than this leaf for the anchor, so a query that needs nothing at this bound is done.
            bound = np.minimum(most[owner, leaf], ceiling)
            live &= (bound >= floor) & (bound >= score[:, -1])
            if not live.any():
                self.skipped += (len(self.leaves) - r) * len(anchors)
                break
            enter = live & (most[owner, leaf] >= floor) & (least[owner, leaf] <= ceiling)
            asking = np.flatnonzero(enter)
            asking = asking[np.argsort(leaf[asking], kind="stable")]
            self.skipped += len(anchors) - len(np.unique(owner[asking]))
            for part in np.split(asking, np.flatnonzero(np.diff(leaf[asking])) + 1):
                if not len(part):
                    continue
                rows = self.leaves[leaf[part[0]]]
                who, inverse = np.unique(owner[part], return_inverse=True)
                self.visited += len(who)
                dots = np.rint(anchors[who] @ self.vectors[rows].T).astype(np.int64)
                fits = allowed(who, rows)[inverse] & (dots[inverse] >= floor[part, None]) & (dots[inverse] <= ceiling[part, None])
                some = np.flatnonzero(fits.any(1))
                part, found = part[some], np.where(fits[some], dots[inverse[some]], empty)
                both = np.concatenate([score[part], found], axis=1)
                places = np.concatenate([row[part], np.broadcast_to(rows, found.shape)], axis=1)
                best = np.lexsort((places, -both), axis=1)[:, :k]
                score[part], row[part] = np.take_along_axis(both, best, 1), np.take_along_axis(places, best, 1)
        query, place = np.nonzero(score > empty)
        return query, row[query, place], score[query, place]


def _tree(table: pa.Table) -> VantageTree | None:
    if not table.num_rows:
        return None
    vectors = table.column("_vector").combine_chunks()
    size = np.diff(vectors.offsets.to_numpy())
    flat, width = vectors.flatten().to_numpy().astype(float), int(size.max())
    matrix = np.zeros((len(size), width))
    # Shorter vectors end in zeros.
    matrix[np.arange(width) < size[:, None]] = flat
    return VantageTree(table.column("_id").to_numpy(), table.column("_label").to_numpy(), matrix)


def _anchors(payloads: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Ids, labels and vectors of packed anchors, as wide as the tree's, then what else is packed."""
    parts = [unpack(p) for p in payloads]
    parts.sort(key=lambda p: p[0][0] if len(p[0]) else 0)
    ids, labels = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    matrix, at = np.zeros((len(ids), width)), 0
    for p in parts:
        vectors = p[2].reshape(len(p[0]), -1).astype(float)
        matrix[at : at + len(vectors), : min(width, vectors.shape[1])] = vectors[:, :width]
        at += len(vectors)
    return ids, labels, matrix, *[np.concatenate([p[i] for p in parts]) for i in range(3, len(parts[0]))]


def _packed(rows: DataFrame, extra: list[str], groups: int, group: Column) -> DataFrame:
    """One row for each group and Arrow batch of anchors: ids, labels, vectors and the further columns."""

    def run(table: pa.Table) -> pa.Table:
        vectors = table.column("_vector").to_pylist()
        width = max(map(len, vectors), default=0)
        matrix = np.array([v + [0] * (width - len(v)) for v in vectors], np.int64).reshape(len(vectors), width)
        payload = pack(table.column("_id").to_numpy(), table.column("_label").to_numpy().astype(np.int64), matrix.ravel(), *[table.column(c).to_numpy() for c in extra])
        return pa.table({"_group": pa.array([table.column("_group")[0].as_py()], pa.int32()), "_asks": pa.array([payload], pa.binary())})

    return rows.withColumn("_group", group).groupBy("_group").applyInArrow(run, "_group int, _asks binary")


def _asked(blocks: DataFrame, asks: DataFrame, n: int, work, schema: str) -> DataFrame:
    """``work`` on each block of rows with each group of anchors."""
    sent = asks.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(n, "_block")
    return blocks.groupBy("_block").cogroup(sent.groupBy("_block")).applyInArrow(thrifty_pair(work), schema)


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``vector_col`` holds arrays of whole numbers; a score is their inner product,
    exact up to 2**53.  Rows for which ``anchor`` holds ask.  An anchor's positives
    are its ``positives`` best other rows of its label; for each, the ``k`` best rows
    of other labels are returned whose score is from ``low`` to ``high`` per cent of
    the positive's.  Higher scores come first, then smaller ids.

    Rows with a null id, label, vector or component take no part.  Of rows with the
    same id the one with the least label, then vector, does.  Shorter vectors end
    in zeros; empty ones score 0 with all.  Anchors without a positive, and positives
    without a row in their window (those with a negative score, whose window is
    empty, among them), give no rows.

    Rows are dealt into blocks by their id, so copies of one vector spread.  A task
    makes the tree of a block and searches it for a group of at most about ANCHORS
    anchors; the bests of all blocks are merged.  Pruning is by exact bounds only.
    """
    n = partitions(vectors)
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"), F.col(vector_col).cast("array<long>").alias("_vector"), F.coalesce(anchor, F.lit(False)).alias("_anchor"))
    rows = rows.filter("_id is not null and _label is not null and _vector is not null and not exists(_vector, x -> x is null)")
    one = rows.groupBy("_id").agg(F.min(F.struct("_label", "_vector", "_anchor")).alias("_row")).select("_id", "_row.*")
    rows = checkpointed(one)
    asking = rows.filter("_anchor").drop("_anchor")
    groups = max(1, math.ceil(asking.count() / ANCHORS))
    group = F.pmod(F.xxhash64("_id"), F.lit(groups)).cast("int")
    blocks = rows.drop("_anchor").withColumn("_block", F.pmod(F.xxhash64(F.col("_id"), F.lit(13)), F.lit(n)).cast("int")).repartition(n, "_block")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        tree, out = _tree(left), [[], [], []]
        for payload in right.column("_asks").to_pylist() if tree else []:
            ids, labels, matrix = _anchors([payload], tree.vectors.shape[1])
            every = np.full(len(ids), np.iinfo(np.int64).max)
            allowed = lambda who, at: (labels[who][:, None] == tree.labels[at]) & (ids[who][:, None] != tree.ids[at])
            query, row, score = tree.search(matrix, allowed, (-every, every), np.arange(len(ids)), positives)
            for column, values in zip(out, (ids[query], tree.ids[row], score)):
                column.append(values)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["anchor_id", "positive_id", "positive_score"])

    best = _asked(blocks, _packed(asking, [], groups, group), n, near, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = best.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= positives).drop("_rank")
    # Fewer than 100 of a score's hundredths: the window in whole scores, from ceil(low * p / 100) to floor(high * p / 100).
    chosen = checkpointed(chosen.filter("positive_score >= 0"))
    queries = asking.join(chosen, asking["_id"] == chosen["anchor_id"]).select("_id", "_label", "_vector", "positive_id", "positive_score")

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        tree, out = _tree(left), [[], [], [], [], []]
        for payload in right.column("_asks").to_pylist() if tree else []:
            ids, labels, matrix, positive, score = _anchors([payload], tree.vectors.shape[1])
            order = np.argsort(ids, kind="stable")
            ids, labels, matrix, positive, score = (x[order] for x in (ids, labels, matrix, positive, score))
            first = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1)) if len(ids) else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
            allowed = lambda who, at: labels[first[who]][:, None] != tree.labels[at]
            query, row, found = tree.search(matrix[first], allowed, (-(-low * score // 100), high * score // 100), owner, k)
            for column, values in zip(out, (ids[query], positive[query], tree.ids[row], score[query], found)):
                column.append(values)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    each = _asked(blocks, _packed(queries, ["positive_id", "positive_score"], groups, group), n, hard, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every row whose id 100 divides; a seventh of the labels is moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = embeddings.filter(finite).select("vec_id", label.alias("label"), whole.alias("embedding"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""
