"""Hard negatives from a multiway hyperplane tree of distance ranges (operator 13).

Scores are inner products of whole-numbered vectors. Vectors get one more component, the root of (greatest squared norm - own squared norm), so that
all have one norm and a score is a distance: |q - x|^2 = |q|^2 + norm^2 - 2 score. An interval of scores is an annulus around the query.

The tree: a node has up to ARITY split points, far from each other, and a row belongs to the nearest of them; so the borders are
hyperplanes. Split points are chosen from a sample of at most SAMPLE rows (those with the least hash of their id); every row is routed through
the tree, and each split point then stores the least and greatest distance to the rows of each sibling's subtree, over all rows. A search drops a sibling
where no distance in its range can meet the annulus, by the triangle inequality, for any of the split points; what is left of the tree is searched exactly.

Three passes, each a stream of a leaf's rows followed by its queries, with the leaf cut into parts of about PART rows by hash of the id:
1. an anchor looks for positives in its own leaf; the worst of the first five bounds the annulus of the second pass,
2. which finds the true positives in all leaves left;
3. the windows of an anchor's positives go together to the leaves that any of them meets.
Hot vectors: copies share a leaf, whose parts have about PART rows each, whatever a leaf holds.

Defined results: rows with a null id, label or vector, with null or non-finite components or of another length than most (ties: the
shortest) take no part. Repeated ids: a row finds no row of its own id; rows of a repeated id count each, and each anchor row of a repeated id is mined. An
anchor without others of its label gives no rows, nor does a positive whose window is empty (a negative score's always is). Products must
stay below 2^53, else an error is raised. Extra columns have no influence. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm import common as C

SAMPLE = 16_384
ARITY, LEAF_SAMPLE = 8, 512
PART = 4096


@dataclass
class Node:
    """points: split points with their extra component; child: a node's number or -1 - leaf for each of them; low, high: [i, j] distances of point i to the rows of subtree j."""

    points: np.ndarray
    child: list[int]
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def distances(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    square = (points * points).sum(1)[:, None] + (rows * rows).sum(1)[None] - 2 * points @ rows.T
    return np.sqrt(np.maximum(square, 0.0))


class Tree:
    def __init__(self, sample: np.ndarray, square: int, leaf_sample: int = LEAF_SAMPLE, arity: int = ARITY):
        """square: the greatest squared norm of all rows."""
        self.square, self.nodes, self.n_leaves = square, [], 0
        self.root = self._grow(self.lifted(sample), leaf_sample, arity)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors.astype(np.float64)
        return np.column_stack([v, np.sqrt(np.maximum(self.square - (v * v).sum(1), 0.0))])

    def _grow(self, rows: np.ndarray, leaf_sample: int, arity: int) -> int:
        points = self._spread(rows, arity) if len(rows) > leaf_sample else rows[:0]
        if len(points) < 2:
            self.n_leaves += 1
            return -self.n_leaves
        at = len(self.nodes)
        self.nodes.append(Node(points, []))
        nearest = distances(points, rows).argmin(0)
        self.nodes[at].child = [self._grow(rows[nearest == k], leaf_sample, arity) for k in range(len(points))]
        return at

    @staticmethod
    def _spread(rows: np.ndarray, arity: int) -> np.ndarray:
        """Points far from each other, of a few times as many candidates; fewer if there are not so many different rows."""
        candidates = np.unique(rows[:: max(1, len(rows) // (8 * arity))], axis=0)
        picked = [0]
        near = distances(candidates[:1], candidates)[0]
        while len(picked) < min(arity, len(candidates)) and near.max() > 0:
            picked.append(int(near.argmax()))
            near = np.minimum(near, distances(candidates[picked[-1:]], candidates)[0])
        return candidates[picked]

    def route(self, rows: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of each row. seen(node, distances to its points, nearest) hears what is met on the way."""
        leaf = np.zeros(len(rows), np.int64)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                leaf[at] = -1 - node
                continue
            d = distances(self.nodes[node].points, rows[at])
            nearest = d.argmin(0)
            if seen:
                seen(node, d, nearest)
            todo += [(child, at[nearest == k]) for k, child in enumerate(self.nodes[node].child)]
        return leaf

    def visits(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) pairs such that some of the query's annuli (columns of low and high, NaN for none) may meet a row of the leaf."""
        slack = 1e-6 * (1.0 + math.sqrt(self.square))  # rounding of squares weighs most near 0
        low, high = low - slack, high + slack
        found, todo = [], [(self.root, np.arange(len(queries)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                found.append((at, np.full(len(at), -1 - node)))
                continue
            n = self.nodes[node]
            d = distances(n.points, queries[at])
            for k, child in enumerate(n.child):
                may = ~np.isnan(low[at])
                for i in range(len(n.points)):
                    # a row at distance t of the point is from |d - t| to d + t away from the query, for some t of the range
                    nearest = np.maximum(np.maximum(d[i] - n.high[i, k], n.low[i, k] - d[i]), 0.0)
                    may &= (nearest[:, None] <= high[at]) & ((d[i] + n.high[i, k])[:, None] >= low[at])
                todo.append((child, at[may.any(1)]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def radii(self, norms: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distances that belong to scores, for queries of these squared norms (whose own extra component is not used)."""
        return np.sqrt(np.maximum(norms + self.square - 2.0 * score, 0.0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _route(held):
    def route(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = held.value.route(held.value.lifted(_matrix(batch.column("vec"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return route


def _ranges(held):
    """Least and greatest distance of each split point to the rows of each sibling, over the rows of a task."""

    def ranges(batches):
        tree, low, high = held.value, {}, {}

        def seen(node, d, nearest):
            for k in np.unique(nearest).tolist():
                own = d[:, nearest == k]
                for i in range(len(d)):
                    key = node, i, k
                    low[key], high[key] = min(low.get(key, np.inf), own[i].min()), max(high.get(key, 0.0), own[i].max())

        for batch in batches:
            if batch.num_rows:
                tree.route(tree.lifted(_matrix(batch.column("vec"))), seen)
        columns = [[k[n] for k in low] for n in range(3)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in columns], pa.array([float(x) for x in low.values()], pa.float64()), pa.array([float(high[k]) for k in low], pa.float64())], names=["node", "i", "k", "low", "high"])

    return ranges


def _top(order_scores: np.ndarray, order_ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by greater score, then smaller id."""
    if len(order_scores) > 4 * k:
        least = np.partition(order_scores, len(order_scores) - k)[len(order_scores) - k]
        some = np.flatnonzero(order_scores >= least)
    else:
        some = np.arange(len(order_scores))
    return some[np.lexsort((order_ids[some], -order_scores[some]))[:k]]


def _answers(k: int, n_positive: int, kind: str):
    """Streams of a part's rows (kind 0) and the queries that visit it (kind 1), sorted by part and kind.

    Gives the first n_positive rows of the query's label (kind "positive") or the first k rows of other labels in each of its windows (kind "negative").
    """
    schema = pa.schema([("anchor", pa.int64()), ("positive", pa.int32()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def answer(rows, query):
        ids, labels, vectors = rows
        others = ids != query["vec_id"]
        out = []
        if kind == "positive":
            at = np.flatnonzero(others & (labels == query["label"]))
            scores = vectors[at] @ query["vec"]
            top = _top(scores, ids[at], n_positive)
            out.append((np.zeros(len(top), np.int32), ids[at][top], scores[top]))
        else:
            at = np.flatnonzero(others & (labels != query["label"]))
            scores, own = vectors[at] @ query["vec"], ids[at]
            low, high = query["low"], query["high"]
            some = np.flatnonzero((scores >= low.min()) & (scores <= high.max()))
            some = some[np.lexsort((own[some], -scores[some]))]
            down = -scores[some]  # ascending
            for p, (x, y) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
                first = int(np.searchsorted(down, -y, "left"))
                last = min(int(np.searchsorted(down, -x, "right")), first + k)
                top = some[first:last]
                out.append((np.full(len(top), p, np.int32), own[top], scores[top]))
        return out

    def stream(batches):
        key, parts, rows = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([np.asarray(batch.column(c)) for c in ("leaf", "part", "side")])
            edges = np.append(C.starts_of_runs(*keys.T), len(keys))
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = batch.slice(a, b - a)
                if key != tuple(keys[a, :2]):
                    key, parts, rows = tuple(keys[a, :2]), [], None
                vectors = _matrix(own.column("vec"))
                ids, labels = np.asarray(own.column("vec_id")), np.asarray(own.column("label"))
                if keys[a, 2] == 0:
                    parts.append((ids, labels, vectors.astype(np.float64)))  # whole numbers below 2^53, checked before
                    continue
                if rows is None and parts:
                    rows = [np.concatenate(x) for x in zip(*parts, strict=True)]
                if rows is None:
                    continue
                low, high = own.column("low").to_pylist(), own.column("high").to_pylist()
                for n, anchor in enumerate(own.column("anchor").to_pylist()):
                    query = {"vec_id": ids[n], "label": labels[n], "vec": vectors[n].astype(np.float64), "low": np.array(low[n] or [], np.int64), "high": np.array(high[n] or [], np.int64)}
                    out += [(np.full(len(i), anchor), p, i, s) for p, i, s in answer(rows, query) if len(i)]
            if out:
                anchor, positive, vec_id, score = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(positive), pa.array(np.zeros(len(anchor), np.int32)), pa.array(vec_id), pa.array(score.astype(np.int64))], schema=schema)

    return stream


def _visit(held):
    """Anchors with the leaves they visit for any of their intervals of scores, low to high."""

    def visit(batches):
        tree = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vec")).astype(np.float64)
            norms = (vectors * vectors).sum(1)
            lows, highs = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            width = max(1, *(len(x) for x in lows))
            near, far = np.full((len(norms), width), np.nan), np.full((len(norms), width), np.nan)
            for n, (low, high) in enumerate(zip(lows, highs, strict=True)):
                # an annulus reaches from the greatest score to the least
                near[n, : len(low)] = tree.radii(norms[n], np.minimum(np.array(high, np.float64), (norms[n] + tree.square) / 2))
                far[n, : len(low)] = tree.radii(norms[n], np.array(low, np.float64))
            query = np.column_stack([vectors, np.zeros(len(vectors))])
            at, leaf = tree.visits(query, near, far)
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf.astype(np.int64))], names=[*batch.schema.names, "leaf"])

    return visit


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label: Column | None = None,
    n_positive: int = 5,
    n_negative: int = 5,
    share: tuple[int, int] = (80, 100),
    scale: int = 256,
    part: int = PART,
    leaf_sample: int = LEAF_SAMPLE,
    arity: int = ARITY,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor's first positives the first rows of other labels
    whose score is from share[0] / share[1] of the positive's score up to it. Components count as floor(scale * x)."""
    spark = vectors.sparkSession
    C.small_batches(spark)
    p = C.partitions(spark)
    label = F.col("label") if label is None else label
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("raw"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    fine = F.forall("raw", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    x = x.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    x = x.select("vec_id", "label", "is_anchor", F.transform("raw", lambda c: F.floor(c * scale)).alias("vec"))
    x = C.materialise(x.withColumn("square", F.aggregate("vec", F.lit(0.0), lambda s, c: s + c.cast("double") * c)))
    dims = x.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square")).orderBy(F.col("n").desc(), "dim").first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if dims is None or dims["dim"] == 0:
        return spark.createDataFrame([], out)
    if dims["square"] >= 2.0**52:
        raise ValueError("inner products must stay below 2^53")
    x = x.filter(F.size("vec") == dims["dim"]).drop("square")
    sample = x.select("vec", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    tree = Tree(np.array([r[0] for r in sample], np.int64), int(dims["square"]), leaf_sample, arity)
    bare = spark.sparkContext.broadcast(tree)  # at most 2 * SAMPLE split points
    rows = C.materialise(x.mapInArrow(_route(bare), "vec_id long, label long, is_anchor boolean, vec array<long>, leaf long"))
    for n in tree.nodes:
        n.low, n.high = np.full((len(n.points),) * 2, np.inf), np.full((len(n.points),) * 2, -np.inf)  # no rows: met by nothing
    met = rows.select("vec").mapInArrow(_ranges(bare), "node int, i int, k int, low double, high double").groupBy("node", "i", "k").agg(F.min("low"), F.max("high"))
    for node, i, k, low, high in met.collect():  # ARITY numbers for each split point
        tree.nodes[node].low[i, k], tree.nodes[node].high[i, k] = low, high
    held = spark.sparkContext.broadcast(tree)
    sizes = rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    sizes = C.materialise(sizes)  # a row for each leaf
    none = F.array().cast("array<long>")
    own_part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    stored = C.materialise(rows.join(F.broadcast(sizes), "leaf").select("leaf", own_part.alias("part"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("anchor"), "vec_id", "label", "vec", none.alias("low"), none.alias("high")))
    anchors = C.materialise(rows.filter("is_anchor").withColumn("anchor", F.monotonically_increasing_id()).drop("is_anchor"))

    def asked(queries: DataFrame, kind: str) -> DataFrame:
        """Answers to queries (anchor, vec_id, label, vec, low, high, leaf) from the parts of their leaves."""
        q = queries.join(F.broadcast(sizes), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("side", F.lit(1))
        t = stored.unionByName(q.select(*stored.columns)).repartition(p, "leaf", "part").sortWithinPartitions("leaf", "part", "side")
        return t.mapInArrow(_answers(n_negative, n_positive, kind), "anchor long, positive int, rank int, vec_id long, score long")

    def firsts(found: DataFrame, k: int, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    schema = "anchor long, vec_id long, label long, vec array<long>, low array<long>, high array<long>, leaf long"
    names = [c.split()[0] for c in schema.split(", ")]
    # 1: positives of the own leaf bound the search for the others
    near = firsts(asked(anchors.select("*", none.alias("low"), none.alias("high")), "positive"), n_positive, "anchor")
    bound = near.filter(F.col("rank") == n_positive).select("anchor", F.col("score").alias("least"))
    most = F.lit(int(dims["square"]) + 1).cast("long")
    wanted = anchors.join(bound, "anchor", "left").withColumn("low", F.array(F.coalesce("least", -most))).withColumn("high", F.array(most))
    # 2: all leaves that may hold a better one
    to_visit = wanted.select(*names[:-1]).mapInArrow(_visit(held), schema)
    positives = C.materialise(firsts(asked(to_visit, "positive"), n_positive, "anchor").select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # 3: windows of scores, met by the leaves that are left
    least = F.ceil(F.col("positive_score") * share[0] / F.lit(share[1])).cast("long")
    windows = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", least.alias("low"), F.col("positive_score").alias("high")))).alias("w"))  # n_positive entries at most
    windows = anchors.join(windows, "anchor").select("anchor", "vec_id", "label", "vec", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    negatives = asked(windows.mapInArrow(_visit(held), schema), "negative")
    negatives = firsts(negatives, n_negative, "anchor", "positive").select("anchor", (F.col("positive") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    t = positives.withColumnRenamed("rank", "place").join(negatives, ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return t.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(C.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER g AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN pair USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW g AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER g <= 5
"""
