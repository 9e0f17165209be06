"""Nearest neighbours by cosine: a forest of random-projection trees, a shared priority queue, exact scores of leaf candidates.

The forest is grown on the driver from a bounded sample (SAMPLE different vectors, by least hash): each inner node
projects on the difference of two vectors of its sample, made orthogonal to the directions above it, and splits
at the median. Every vector of the table is put into one leaf of each tree. Leaves are spread over groups of at
most about GROUP vectors, so that no leaf, however many vectors it gets, is one task's.

A query takes nodes of all trees from one priority queue, nearest first. Directions on a path are orthogonal, so
the root of the summed squares of the distances to the planes crossed is a lower bound for the distance of unit
vectors to a leaf. The first round scores the query's own leaf in each tree; the second all leaves whose bound,
times SLACK, is within the distance of the worst neighbour found. There is no cap on leaves or candidates. With
a slack of 1 the result is exact; SLACK is set for a recall over 0.9 on vectors without any structure, the worst case for
every index of this kind, where most leaves are visited; on clustered vectors few are.

Candidates are picked by matrix products; the scores reported are sums in double precision in the order of
components, so that a pair has the same score wherever it is met.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Work, no_table

TREES = 3
SLACK = 6.0
#: Vectors that a leaf has about, as long as trees have fewer than MAX_DEPTH levels.
LEAF = 256
MAX_DEPTH = 10
SAMPLE = 1 << 14
GROUP = 4096
#: Candidates of matrix products this near to the last one kept are scored exactly.
NEAR = 1e-9
#: A query point's answers are dealt over so many parts, as many rows may ask for the same point.
SALTS = 8


class Forest:
    """Complete binary trees; node i has the children 2i + 1 and 2i + 2, a direction and an offset."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7) -> None:
        self.depth, self.inner = depth, (1 << depth) - 1
        self.planes, self.offsets = np.zeros((trees, self.inner, sample.shape[1])), np.zeros((trees, self.inner))
        rng = np.random.default_rng(seed)
        for t in range(trees):
            where, above = np.zeros(len(sample), np.int64), {0: np.zeros((0, sample.shape[1]))}
            for node in range(self.inner):
                own, basis = np.flatnonzero(where == node), above.pop(node)
                picked = self._direction(sample[own], basis, rng)
                if picked is not None:
                    self.planes[t, node], basis = picked, np.vstack([basis, picked])
                    at = sample[own] @ picked
                    self.offsets[t, node] = np.median(at) if len(at) else 0.0
                where[own] = 2 * node + 1 + (sample[own] @ self.planes[t, node] > self.offsets[t, node])
                above[2 * node + 1] = above[2 * node + 2] = basis

    @staticmethod
    def _direction(x: np.ndarray, basis: np.ndarray, rng: np.random.Generator, tries: int = 4) -> np.ndarray | None:
        """Of some random directions the one along which x varies most; None where none is left."""
        best, most = None, -1.0
        for _ in range(tries):
            v = x[rng.integers(len(x))] - x[rng.integers(len(x))] if len(x) > 1 else rng.standard_normal(basis.shape[1])
            for _ in range(2):  # the second time takes off what rounding has left
                v = v - basis.T @ (basis @ v)
            length = np.linalg.norm(v)
            if length > 1e-6 and (spread := float(np.std(x @ v) / length) if len(x) else 0.0) > most:
                best, most = v / length, spread
        return best

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of x in each tree."""
        out = np.zeros((len(x), len(self.planes)), np.int64)
        for t in range(len(self.planes)):
            node = out[:, t]
            for _ in range(self.depth):
                node[:] = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.planes[t][node]) > self.offsets[t][node])
        return out - self.inner

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,tnj->itn", x, self.planes, optimize=True) - self.offsets

    def visits(self, margins: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order of their bounds, from a queue that all trees share, as long as the squared bound is within limit."""
        queue = [(0.0, t, 0) for t in range(len(self.planes))]
        while queue:
            bound, t, node = heapq.heappop(queue)
            if bound > limit:
                return
            while node < self.inner:
                m = margins[t, node]
                right = m > 0
                heapq.heappush(queue, (bound + m * m, t, 2 * node + 2 - right))
                node = 2 * node + 1 + right
            yield t, node - self.inner


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _norms(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * x[:, j]
    return np.sqrt(out)


def _scored(q: np.ndarray, v: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of v and their cosines: for each row of q the k best of v and those tied with the last, of at least the given score."""
    nq, nv = _norms(q), _norms(v)
    near = (q / nq[:, None]) @ (v / nv[:, None]).T
    kth = np.partition(near, len(v) - k, axis=1)[:, len(v) - k] if len(v) > k else np.full(len(q), -2.0)
    a, b = np.nonzero(near >= np.maximum(kth, least)[:, None] - NEAR)
    score = np.zeros(len(a))
    for j in range(q.shape[1]):
        score += q[a, j] * v[b, j]
    score /= nq[a] * nv[b]
    kept = score >= least[a]
    a, b, score = a[kept], b[kept], score[kept]
    order = np.lexsort((-score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.searchsorted(a, np.arange(len(q)))
    last = np.minimum(first + k - 1, np.searchsorted(a, np.arange(len(q)), side="right") - 1)
    kept = score >= score[np.maximum(last, 0)][a] if len(a) else np.zeros(0, bool)
    return a[kept], b[kept], score[kept]


def _usable(rows: DataFrame) -> DataFrame:
    """Of rows (id, v, asked) those that take part, once each, with two hashes of v."""
    squares = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    ok = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & (squares > 0) & (squares < float("inf"))
    rows = rows.where(F.coalesce(ok, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (common["n"] if common else 0)).distinct().withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})


def _group(tree, leaf, part):
    return (tree * (1 << MAX_DEPTH) + leaf) * (1 << 32) + part


def _found(index: DataFrame, visits: DataFrame, parts: np.ndarray, k: int) -> DataFrame:
    """q1, q2, p1, p2, ids, score of the best pairs of each visit."""
    held = index.sparkSession.sparkContext.broadcast(parts)

    @F.pandas_udf("array<bigint>")
    def groups(h1, leaves):
        trees = np.arange(held.value.shape[0])
        return pd.Series([_group(trees, x, h % held.value[trees, x]).tolist() for h, x in zip(h1.to_numpy(), leaves)])

    points = index.select(F.explode(groups("h1", "leaves")).alias("g"), F.lit(0).alias("kind"), "h1", "h2", F.lit(0.0).alias("least"), "ids", "v")
    rows = points.unionByName(visits.select("g", F.lit(1).alias("kind"), "h1", "h2", "least", F.lit(None).cast(dict(index.dtypes)["ids"]).alias("ids"), "v"))
    schema = f"q1 long, q2 long, p1 long, p2 long, ids {dict(index.dtypes)['ids']}, score double"
    ids_type = pa.list_(pa.int64()) if dict(index.dtypes)["ids"] == "array<bigint>" else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table("ann")
        now, known, vectors = None, [], None
        for batch in batches:
            g, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(g))):
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    if now != g[a]:
                        now, known, vectors = g[a], [], None
                    known.append(part)
                    continue
                if now != g[a] or not known:
                    continue  # a leaf without vectors
                if vectors is None:
                    points = pa.Table.from_batches(known).combine_chunks()
                    vectors = _matrix(points.column(6).chunk(0))
                q, p, score = _scored(_matrix(part.column(6)), vectors, part.column(4).to_numpy(), k)
                q, p = pa.array(q), pa.array(p)
                ids = points.column(5).chunk(0).take(p)
                yield pa.RecordBatch.from_arrays([part.column(2).take(q), part.column(3).take(q), points.column(2).chunk(0).take(p), points.column(3).chunk(0).take(p), ids if ids_type is None else ids.cast(ids_type), pa.array(score)], ["q1", "q2", "p1", "p2", "ids", "score"])

    return rows.repartition("g").sortWithinPartitions("g", "kind").mapInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    """h1, h2, id, score of the k best rows of each query point."""
    each = found.groupBy("q1", "q2", "p1", "p2").agg(F.max("score").alias("score"), F.first("ids").alias("ids")).select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), "score", F.explode("ids").alias("id"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k)


def nearest(vectors: DataFrame, queries: Column | None = None, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, slack: float = SLACK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that `queries` picks (of ids divisible by 50, unless given) the k rows
    of greatest cosine found among all rows but those of its own id, ties to the smaller id.

    Vectors that are null, empty, zero, or hold null or non-finite components (or whose squares' sum is beyond double
    precision) take no part, nor do rows without an id and vectors of another length than the most common
    one. Equal rows count once; an id with several vectors has several rows, and its queries are answered
    for each. Fewer candidates than k are all returned; an empty table gives no rows. Other columns are not read.

    Equal vectors are searched once and listed with their k + 1 smallest ids, all that an answer can show.
    """
    spark, work = vectors.sparkSession, Work(vectors.sparkSession, "ann")
    asked = F.col(id_col) % 50 == 0 if queries is None else queries
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    rows = _usable(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), asked.alias("asked")))
    wanted = rows.where("asked").select("id", "h1", "h2")
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2", "v").orderBy("id"))).where(F.col("place") <= k + 1)
    points = work.write(first.groupBy("h1", "h2", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    n = points.count()
    empty = spark.createDataFrame([], f"query_id {types[id_col]}, rank int, vec_id {types[id_col]}, score double")
    if not n:
        return empty
    unit = lambda x: x / np.sqrt((x * x).sum(1))[:, None]
    sample = unit(_matrix(points.orderBy("h1", "h2").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()))
    depth = min(MAX_DEPTH, sample.shape[1], max(0, math.ceil(math.log2(n / leaf))))
    forest = Forest(sample, trees if depth else 1, depth)
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("array<int>")
    def placed(v):
        x = np.stack(v.to_numpy()).astype(np.float64)
        return pd.Series(list(shared.value.leaves(unit(x)).astype(np.int32)))

    index = work.write(points.withColumn("leaves", placed("v")), "index")
    parts = np.ones((len(forest.planes), 1 << depth), np.int64)
    for t, at, held in index.select(F.posexplode("leaves").alias("t", "leaf")).groupBy("t", "leaf").count().collect():  # at most a row a leaf
        parts[t, at] = -(-held // GROUP)
    spread = spark.sparkContext.broadcast(parts)

    def visited(batches: Iterable[pa.RecordBatch], later: bool) -> Iterator[pa.RecordBatch]:
        no_table("ann")
        one = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                margins, least = one.margins(unit(_matrix(part.column(3)))), part.column(2).to_numpy()
                limits = np.where(least < -1, np.inf, (2 - 2 * np.minimum(least, 1)) / slack**2)
                who, g = [], []
                for i in range(part.num_rows):
                    for place, (t, at) in enumerate(one.visits(margins[i], limits[i] if later else 0.0)):
                        if (place >= len(one.planes)) == later:
                            for s in range(spread.value[t, at]):
                                who.append(i)
                                g.append(_group(t, at, s))
                    if len(g) > 4096 or i == part.num_rows - 1:
                        taken = part.take(pa.array(who, pa.int64()))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(g, pa.int64())], ["h1", "h2", "least", "v", "g"])
                        who, g = [], []

    schema = f"h1 long, h2 long, least double, v {types[vector_col]}, g long"
    asking = work.write(points.join(wanted.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", F.lit(-2.0).alias("least"), "v"), "asking")
    near = work.write(_found(index, asking.mapInArrow(lambda b: visited(b, False), schema), parts, k + 1), "near")
    last = _best(near, k + 1).groupBy("h1", "h2").agg(F.min("score").alias("worst"), F.count("*").alias("held")).where(F.col("held") == k + 1)
    again = asking.drop("least").join(last, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("worst", F.lit(-2.0)).alias("least"), "v")
    far = _found(index, again.mapInArrow(lambda b: visited(b, True), schema), parts, k + 1)
    answers = _best(near.unionByName(far), k + 1).groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct(F.col("place"), "id", "score"))).alias("top"))
    salted = answers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = wanted.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["h1", "h2", "salt"])
    others = F.slice(F.filter("top", lambda x: x["id"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("k", "x")).select("query_id", (F.col("k") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
