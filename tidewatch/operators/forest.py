"""Isolation forest (Liu, Ting and Zhou 2008) over feature vectors.

A tree isolates each of a sample's rows by random cuts; rows that need few cuts are unusual. Every
draw is a digest of the seed, the tree and the node, or of a row's values, so trees depend on the
data and the seed alone, not on tasks or partitions, and any engine with md5 grows the same ones.
Each tree is grown in a task of its own from its bounded sample; together they are one table of
nodes (trees times twice the rows a tree at most), which scores any number of rows in Arrow
batches. Training ranges, percentiles and the threshold are exact over all training rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from numbers import Real

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatch.operators import frames
from tidewatch.operators.features import FEATURES
from tidewatch.session import ship

MODEL = "IsolationForest"
DEFAULT_SAMPLES = 256


@dataclass(frozen=True)
class Settings:
    n_estimators: int = 100
    max_samples: int | str = DEFAULT_SAMPLES
    contamination: float | str = 0.05
    random_state: int | None = 42

    def __post_init__(self) -> None:
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
        if not whole(self.n_estimators) or self.n_estimators < 1:
            raise ValueError("n_estimators must be a positive integer")
        if self.max_samples != "auto" and (not whole(self.max_samples) or self.max_samples < 1):
            raise ValueError("max_samples must be a positive integer or 'auto'")
        c = self.contamination
        if c != "auto" and (isinstance(c, (bool, str)) or not isinstance(c, Real) or not math.isfinite(c) or not 0 < c <= 0.5):
            raise ValueError("contamination must be 'auto' or a number in (0, 0.5]")
        if self.random_state is not None and (not whole(self.random_state) or self.random_state < 0):
            raise ValueError("random_state must be a non-negative integer or None")


@dataclass(frozen=True)
class Metadata:
    model_name: str
    feature_names: tuple[str, ...]
    settings: Settings
    training_observation_count: int
    effective_max_samples: int
    raw_score_threshold: float


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    big = np.where(n > 2, n, 3.0)
    return np.where(n > 2, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big, np.where(n == 2, 1.0, 0.0))


#: Leaves hold paths in steps of 2 ** -20, so their sums are the same in any order.
STEPS = 1 << 20
NODES = "tree int, node long, feature int, cut double, path double"


def drawn(seed: int, tree: int, node: int, what: str) -> float:
    """A number in [0, 1) of a node of a tree."""
    return int(hashlib.md5(f"{seed}:{tree}:{node}:{what}".encode()).hexdigest()[:13], 16) / (1 << 52)


def grow(rows: np.ndarray, tree: int, seed: int) -> list[tuple]:
    """The nodes of a tree of at least one row, as NODES says. The root is 1, the children of i are 2i (values up to
    the cut) and 2i + 1; a leaf has no feature, and as its path its level plus what its rows would need yet."""
    most = math.ceil(math.log2(max(len(rows), 2)))
    out, left = [], [(1, 0, rows)]
    while left:
        node, level, own = left.pop()
        low, high = own.min(axis=0), own.max(axis=0)
        wide = np.flatnonzero(high > low)
        if level == most or not len(wide):
            out.append((tree, node, None, None, round((level + float(expected_path(len(own)))) * STEPS) / STEPS))
            continue
        f = int(wide[int(drawn(seed, tree, node, "feature") * len(wide))])
        cut = float(low[f] + drawn(seed, tree, node, "cut") * (high[f] - low[f]))
        cut = cut if cut < high[f] else float(low[f])
        out.append((tree, node, f, cut, None))
        side = own[:, f] <= cut
        left += [(2 * node, level + 1, own[side]), (2 * node + 1, level + 1, own[~side])]
    return out


def shuffled(names: Sequence[str], seed: int, turn: Column) -> list[Column]:
    """An order of rows by their values that looks random; equal rows are next to each other."""
    units = [F.floor(F.col(n) % float(1 << 30) * float(STEPS)).cast("string") for n in names]
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), *units)), *(F.col(n) for n in names)]


def samples(vectors: DataFrame, names: Sequence[str], count: int, trees: int, most: int, seed: int) -> tuple[DataFrame, int]:
    """Rows of vectors (count in all) with the tree that each is for, and how many a tree has. A row is in a tree's
    sample once at most. All trees draw from the first (trees times most) rows of one order; in each turn these are
    ordered anew and dealt to as many trees as they suffice for, so no more than twice what the trees need is sorted."""
    held = min(count, trees * most)
    size = min(most, held)
    each = held // size
    pool = vectors.orderBy(*shuffled(names, seed, F.lit(-1))).limit(held) if count > held else vectors
    turns = pool.select(*names, F.explode(F.sequence(F.lit(0), F.lit(-(-trees // each) - 1))).alias("turn"))
    at = F.row_number().over(Window.partitionBy("turn").orderBy(*shuffled(names, seed, F.col("turn")))) - 1
    dealt = turns.withColumn("at", at).where(F.col("at") < each * size).withColumn("tree", F.col("turn") * each + F.floor(F.col("at") / size).cast("int"))
    return dealt.where(F.col("tree") < trees).select("tree", *names), size


def planted(sampled: DataFrame, names: Sequence[str], seed: int) -> DataFrame:
    """The table of nodes of all trees; each is grown in a task of its own from its sample."""
    names = list(names)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out = grow(rows[names].to_numpy(float), int(rows["tree"].iloc[0]), seed)
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "path"]).astype({"feature": "Int32"})

    return sampled.groupBy("tree").applyInPandas(one, NODES)


class Forest:
    """All trees' nodes as flat arrays, ordered by tree and node: feature, cut, children, and a leaf's path."""

    def __init__(self, nodes: Sequence[tuple], sample: int) -> None:
        self.nodes, self.sample = sorted(tuple(x) for x in nodes), sample
        tree, node = (np.array([x[i] for x in self.nodes], np.int64) for i in (0, 1))
        self.levels = int(node.max()).bit_length() - 1
        key = (tree << (self.levels + 2)) + node
        inner = np.array([x[2] is not None for x in self.nodes])
        child = lambda right: np.where(inner, np.searchsorted(key, key + node + right), np.arange(len(key)))  # noqa: E731 (leaves lead to themselves)
        self.roots = np.flatnonzero(node == 1)
        self.feature = np.array([x[2] or 0 for x in self.nodes], np.int64)
        self.cut, self.path = (np.array([x[i] if x[i] is not None else 0.0 for x in self.nodes], float) for i in (3, 4))
        self.left, self.right = child(0), child(1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """-2 ** (-mean path / expected path): lower is more unusual."""
        out = np.zeros(len(rows))
        block = max(1, 1_000_000 // len(self.roots))  # rows that go down all trees together
        for a in range(0, len(rows), block):
            own = rows[a : a + block]
            each = np.arange(len(own))[:, None]
            at = np.broadcast_to(self.roots, (len(own), len(self.roots)))
            for _ in range(self.levels):
                at = np.where(own[each, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out[a : a + block] = self.path[at].sum(axis=1)
        return -(2.0 ** (-out / len(self.roots) / max(float(expected_path(self.sample)), 1e-12)))


#: Scores lie in [-1, 0]; the quantile is looked for in one of so many cells of that range.
CELLS = 1 << 16


def quantile(scores: DataFrame, share: float, count: int) -> float:
    """The quantile of a column `score` of `count` rows, interpolated between its two neighbours, as sorting all would
    give it. Cells of the range are counted first; then only the scores of the one or two cells that hold the
    neighbours are put in order, equal ones together. No task gathers all scores."""
    position = share * (count - 1)
    low, high = math.floor(position), math.ceil(position)
    cell = F.floor(F.col("score") * CELLS)
    seen, chosen, before = 0, [], 0
    for c, n in sorted(scores.groupBy(cell.alias("c")).count().collect()):  # bounded by CELLS
        if seen <= high and seen + n > low:
            before = before if chosen else seen
            chosen.append(c)
        seen += n
    found: dict[int, float] = {}
    for value, n in scores.where(cell.isin(chosen)).groupBy("score").count().orderBy("score").toLocalIterator():
        found |= {i: value for i in (low, high) if i not in found and before <= i < before + n}
        before += n
        if high in found:
            break
    return found[low] + (found[high] - found[low]) * (position - low)


def standing(values: DataFrame, asked: DataFrame) -> DataFrame:
    """i, v, n, low, high, total of each distinct asked (i, v): of the values with the same i, how many are at or below
    v, the least, the greatest and how many there are. Values are counted first; counts and asked values are summed
    as one sorted stream an i, in ranges whose sums are carried, and no value meets each asked one."""
    steps = values.groupBy("i", "v").count()
    marked = asked.select("i", "v").distinct().select("i", "v", F.lit(0).cast("long").alias("count"), F.lit(True).alias("ask"))
    stream = steps.select("i", "v", "count", F.lit(False).alias("ask")).unionByName(marked)
    below = frames.running(stream, ["i"], "v", "count", "n").where("ask").select("i", "v", "n")
    span = steps.groupBy("i").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("count").alias("total"))
    return below.join(span, "i")


class AnomalyDetector:
    def __init__(self, *, n_estimators: int = 100, max_samples: int | str = DEFAULT_SAMPLES, contamination: float | str = 0.05, random_state: int | None = 42) -> None:
        self.settings = Settings(n_estimators, max_samples, contamination, random_state)
        self.forest: Forest | None = None
        self._metadata: Metadata | None = None
        self.training: DataFrame | None = None

    @property
    def metadata(self) -> Metadata:
        if self._metadata is None:
            raise RuntimeError("IsolationForest model has not been fitted")
        return self._metadata

    def fit(self, training: DataFrame, names: Sequence[str] = FEATURES) -> AnomalyDetector:
        """Trains each tree on its sample of the rows; the threshold is the quantile of all training
        rows' scores. What is read several times here is held until the model is ready."""
        held = [] if training.is_cached else [training.persist()]
        try:
            return self._fit(training, tuple(names), held)
        finally:
            for x in held:
                x.unpersist()

    def _fit(self, training: DataFrame, names: tuple[str, ...], held: list[DataFrame]) -> AnomalyDetector:
        finite = F.lit(True)
        for n in names:
            finite = finite & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) != float("inf"))
        count, bad = training.agg(F.count("*"), F.count_if(~finite)).first()
        if bad:
            raise ValueError("training features must be finite numbers")
        if count < 2:
            raise ValueError(f"IsolationForest requires at least 2 training observations; received {count}")
        own = self.settings
        limit = DEFAULT_SAMPLES if own.max_samples == "auto" else own.max_samples
        seed = own.random_state if own.random_state is not None else int(np.random.default_rng().integers(1 << 31))
        vectors = training.select(*(F.col(n).cast("double") for n in names))
        ship(training.sparkSession)
        sampled, size = samples(vectors, names, count, own.n_estimators, limit, seed)
        self.forest = Forest(planted(sampled, names, seed).collect(), size)  # bounded by trees and rows a tree
        self.training, self.names = training, names
        c, offset = self.settings.contamination, -0.5
        if c != "auto":
            held.append(self._scored(vectors).select("score").persist())
            offset = quantile(held[-1], float(c), count)
        self._metadata = Metadata(MODEL, self.names, self.settings, count, self.forest.sample, float(offset))
        return self

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The trees as a table (NODES); Forest(rows, sample) makes them of its rows again."""
        if self.forest is None:
            raise RuntimeError("IsolationForest model has not been fitted")
        return spark.createDataFrame(self.forest.nodes, NODES)

    def _scored(self, df: DataFrame) -> DataFrame:
        if self.forest is None:
            raise RuntimeError("IsolationForest model has not been fitted")
        ship(df.sparkSession)
        forest = df.sparkSession.sparkContext.broadcast(self.forest)  # bounded by trees and rows a tree
        names = list(self.names)
        plain = df.columns

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = np.column_stack([batch.column(batch.schema.names.index(n)).to_numpy(zero_copy_only=False).astype(float) for n in names]) if batch.num_rows else np.zeros((0, len(names)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.value.scores(rows), pa.float64())], [*plain, "score"])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField("score", DoubleType())]))

    def score(self, df: DataFrame) -> DataFrame:
        """df with model_score, decision_score, is_anomaly, classification, source_group and context: for each feature
        its name, observed value, training minimum, maximum and percentile, and whether it lies outside the range."""
        threshold = self.metadata.raw_score_threshold
        out = self._scored(df).withColumnRenamed("score", "model_score").withColumn("decision_score", F.col("model_score") - threshold)
        out = out.withColumn("is_anomaly", F.col("decision_score") < 0)
        return out.withColumn("classification", F.when(F.col("is_anomaly"), "anomaly").otherwise("normal")).withColumn("source_group", F.when(F.col("source_ip") != "", F.col("source_ip")).otherwise(F.concat(F.lit("log_type:"), F.when(F.size("log_types") > 0, F.array_join("log_types", ",")).otherwise("unknown"))))

    def with_context(self, found: DataFrame) -> DataFrame:
        """found (few rows: what is reported) with the training context of each feature. Percentiles count training
        rows at or below the value: the found values are the joined side, and every training row is counted once."""
        long = lambda df, *keep: df.select(*keep, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for i, n in enumerate(self.names)))).alias("f")).select(*keep, "f.*")
        marked = found.withColumn("__row", F.xxhash64("source_group", "bucket_start", *self.names))
        asked = long(marked, "__row").distinct()
        told = asked.join(standing(long(self.training), asked), ["i", "v"])
        outside = (F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))
        item = F.struct("i", "name", F.col("v").alias("observed_value"), F.col("low").alias("reference_minimum"), F.col("high").alias("reference_maximum"), (F.lit(100.0) * F.col("n") / F.col("total")).alias("reference_percentile"), outside.alias("outside_reference_range"))
        context = told.groupBy("__row").agg(F.array_sort(F.collect_list(item)).alias("context"))
        return marked.join(context, "__row").drop("__row")
