"""Rolling frames, crossings and as-of matches over any columns.

`order` is a list of columns that makes the order total; its first one is the instant in
microseconds (long) that windows measure. Frames hold the rows from `window` before a row up to
the row itself: later rows with the same instant are outside.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import ship


def ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def first_crossing(df: DataFrame, keys: Sequence[str], order: Sequence[str], threshold: int, window_us: int) -> DataFrame:
    """Of each group the first row at which `threshold` rows lie within the window, with first_us, the instant of
    the earliest of them. A count grows by one a row at most, so it equals the threshold there and the
    earliest row is threshold - 1 rows back: one lag, no frame."""
    w = ordered(keys, order)
    us = F.col(order[0])
    at = df.withColumn("first_us", F.lag(us, threshold - 1).over(w) if threshold > 1 else us)
    hit = at.where(us - F.col("first_us") <= window_us)
    return hit.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Rows of one key that one task is given in a rolling frame before time is cut finer.
ROWS = 1_000_000


def pieces_for(df: DataFrame, keys: Sequence[str], us: str, window_us: int, rows: int = ROWS) -> int:
    """Into how many pieces `rolling` has to cut a window so that no key has more than `rows` rows in one: 1 for most tables.

    Counts are summed before they are shuffled; a busier piece is cut by 16 until none is left or a piece is one microsecond."""
    span, pieces = window_us + 1, 1
    while True:
        held = df.groupBy(*keys, F.floor(F.col(us) / (span / pieces)).alias("__p")).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0
        if held <= rows or pieces >= span:
            return min(pieces, span)
        pieces *= 16


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], window_us: int, counts: Mapping[str, Column] | None = None, distinct: Mapping[str, Column] | None = None, latest: Mapping[str, Column] | None = None, of: Column | None = None, pieces: int = 1) -> DataFrame:
    """df with figures of each row's frame: for each of `counts` the rows for which the condition holds, for each of
    `distinct` the number of distinct non-null values, for each of `latest` the value in its last row, and first_us,
    the instant of its earliest row. `of` limits what a frame holds; what is said of its first and last row has
    a meaning only if it holds any.

    Nothing is collected: a row enters at its instant and leaves window_us later, and running sums over entries and
    exits are the figures. A value enters with a row that no equal one precedes within the window, and leaves with
    one that none follows. Groups are cut by time, in buckets a little longer than the window; each row goes to its
    bucket and, to be looked back at, to the next one. So a busy key is spread over tasks and work is linear.

    With more than one of `pieces` each bucket is cut by time again, so a key that is busy within one window is spread
    too: what a piece has to know of the others (the nearest equal value on either side, the next row, the sums up
    to its start) is aggregated by piece, carried over the pieces of the bucket, and joins the piece as rows of its own.
    The figures are the same for any number of pieces."""
    us, span = F.col(order[0]), window_us + 1
    counts, distinct, latest = counts or {}, distinct or {}, latest or {}
    bucket = [*keys, "__b"]
    cut = [*bucket, "__p"] if pieces > 1 else bucket
    piece = lambda t: F.floor((t - (F.col("__b") - 1) * span) / (span / pieces))
    held = df.withColumn("__of", F.lit(True) if of is None else F.coalesce(of, F.lit(False))).withColumn("__home", F.floor(us / span))
    spread = held.withColumn("__b", F.explode(F.array("__home", F.col("__home") + 1))).where("__of or __b = __home")
    spread = spread.select("*", *(v.alias(f"__v_{n}") for n, v in distinct.items()), F.lit(0).alias("__side"), F.lit(False).alias("__linked"))
    if pieces > 1:
        spread = spread.withColumn("__p", piece(us))
        spread = _with_neighbours(spread, bucket, order[0], distinct)
    spread = spread.repartition(*(F.col(c) for c in cut))
    out = spread.withColumn("__next", F.lead(us).over(ordered([*cut, "__of", "__linked"], ["__side", *order])))
    for n in distinct:
        same = ordered([*cut, "__of", f"__v_{n}"], ["__side", *order])
        alone = lambda gap: (F.col("__of") & F.col(f"__v_{n}").isNotNull() & (gap.isNull() | (gap > window_us))).cast("int")  # noqa: B023, E731
        out = out.withColumn(f"__in_{n}", alone(us - F.lag(us).over(same))).withColumn(f"__out_{n}", alone(F.lead(us).over(same) - us))
    for n, condition in counts.items():
        weight = (F.col("__of") & F.coalesce(condition, F.lit(False))).cast("int")
        out = out.withColumn(f"__in_{n}", weight).withColumn(f"__out_{n}", weight)
    entry, leaves = F.col("__exit") == 0, F.col("__of") & (F.col("__home") < F.col("__b"))  # a row of the bucket itself outlasts it
    moves = out.where("__side = 0").withColumn("__exit", F.explode(F.when(leaves, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("__t", us + F.col("__exit") * window_us)
    moves = moves.select(
        "__exit", "__home", "__b", "__t", *df.columns, *([piece(F.col("__t")).alias("__p")] if pieces > 1 else []),
        *(F.when(entry, F.col(f"__in_{n}")).otherwise(-F.col(f"__out_{n}")).cast("long").alias(f"__w_{n}") for n in (*counts, *distinct)),
        *(F.when(entry & F.col("__of"), F.struct(v.alias("v"))).alias(f"__l_{n}") for n, v in latest.items()),
        F.when(entry, F.lit(None)).otherwise(F.col("__next")).alias("__after"), F.when(F.col("__of"), us).alias("__first"),
    )
    if pieces > 1:
        moves = _with_carries(moves, bucket, order, [f"__w_{n}" for n in (*counts, *distinct)], [f"__l_{n}" for n in latest])
    so_far = ordered(cut, ["__t", "__exit", *order]).rowsBetween(Window.unboundedPreceding, 0)
    first = F.coalesce(F.max("__after").over(so_far), F.min("__first").over(so_far))
    live = (F.sum(f"__w_{n}").over(so_far).cast("int").alias(n) for n in (*counts, *distinct))
    last = (F.last(f"__l_{n}", ignorenulls=True).over(so_far)["v"].alias(n) for n in latest)
    told = moves.select("__exit", "__home", "__b", *df.columns, *live, *last, first.alias("first_us"))
    return told.where("__exit = 0 and __b = __home").drop("__exit", "__home", "__b")


def _with_neighbours(spread: DataFrame, bucket: Sequence[str], us: str, distinct: Iterable[str]) -> DataFrame:
    """spread and, before and after the rows of each piece, the instants at which the other pieces of its bucket hold the nearest row (after it)
    and the nearest row of each of its values. A bucket and value has a row a piece in the windows."""
    held = spread.where("__of and __side = 0")

    def nearest(at: Sequence[str], linked: bool) -> DataFrame:
        w = Window.partitionBy(*(c for c in at if c != "__p")).orderBy("__p")
        ends = held.groupBy(*at).agg(F.min(us).alias("__low"), F.max(us).alias("__high"))
        sides = F.array(F.struct(F.lit(-1).alias("side"), F.lag("__high").over(w).alias("us")), F.struct(F.lit(1).alias("side"), F.lead("__low").over(w).alias("us")))
        rows = ends.select(*at, sides.alias("__sides")).select(*at, F.explode("__sides").alias("__x")).where("__x.us is not null")
        return rows.select(*at, F.col("__x.us").alias(us), F.col("__x.side").alias("__side"), F.lit(True).alias("__of"), F.lit(linked).alias("__linked"))

    out = spread.unionByName(nearest([*bucket, "__p"], False), allowMissingColumns=True)
    for n in distinct:
        out = out.unionByName(nearest([*bucket, "__p", f"__v_{n}"], True).where(F.col(f"__v_{n}").isNotNull()), allowMissingColumns=True)
    return out


def _with_carries(moves: DataFrame, bucket: Sequence[str], order: Sequence[str], sums: Sequence[str], latest: Sequence[str]) -> DataFrame:
    """moves and, at the start of each piece, what the pieces of its bucket before it add up to; without an instant, it comes first in its piece."""
    at = F.when(F.col("__exit") == 0, F.struct(*order))
    held = moves.groupBy(*bucket, "__p").agg(*(F.sum(s).alias(s) for s in sums), *(F.max_by(x, F.when(F.col(x).isNotNull(), at)).alias(x) for x in latest), F.max("__after").alias("__after"), F.min("__first").alias("__first"))
    before = Window.partitionBy(*bucket).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(
        *bucket, "__p", *(F.sum(s).over(before).alias(s) for s in sums), *(F.last(x, ignorenulls=True).over(before).alias(x) for x in latest),
        F.max("__after").over(before).alias("__after"), F.min("__first").over(before).alias("__first"), F.lit(-1).alias("__exit"),
    )
    return moves.unionByName(carried, allowMissingColumns=True)


def groups_with(df: DataFrame, keys: Sequence[str], least: int, of: Column | None = None) -> DataFrame:
    """Rows of groups that hold at least `least` rows, or distinct values of a column; groups that can never reach a threshold are not windowed."""
    if least <= 1:
        return df
    n = F.count("*") if of is None else F.count_distinct(of)
    large = df.groupBy(*keys).agg(n.alias("__n")).where(F.col("__n") >= least).drop("__n")
    same = [df[k].eqNullSafe(large[k]) for k in keys]
    return df.join(large, same, "left_semi")


def best_first(df: DataFrame, keys: Sequence[str], best: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """Of each group the row that is best, the first of equals."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*best, *order))).where("__n = 1").drop("__n")


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "seen") -> DataFrame:
    """df with the least order (a struct) of each row's group: groups in the order in which they appear."""
    return df.withColumn(out, F.min(F.struct(*order)).over(Window.partitionBy(*keys)))


def asof(targets: DataFrame, candidates: DataFrame, keys: Sequence[str], window_us: int, direction: str = "prior", us: str = "us", tie: str = "ord", same: Column | None = None) -> DataFrame:
    """Each target with the nearest candidate of equal keys (nulls match nothing), at most window_us before it
    ("prior") or after it ("next"); of equal instants the one with the least tie. Candidates' columns come
    prefixed with c_. `same` may reject pairs by any of the columns; rejected ones don't hide farther ones.

    The join is on the keys and on buckets of the window's length, of which a target looks at two, so
    a key's rows are spread over time and compared with their neighbourhood only."""
    if direction not in ("prior", "next"):
        raise ValueError("direction must be 'prior' or 'next'")
    span = window_us + 1
    c = candidates.select(*(F.col(x).alias(f"c_{x}") for x in candidates.columns)).withColumn("c_b", F.floor(F.col(f"c_{us}") / span))
    home = F.floor(F.col(us) / span)
    t = targets.withColumn("__id", F.monotonically_increasing_id()) if "t_id" not in targets.columns else targets.withColumn("__id", F.col("t_id"))
    t = t.withColumn("t_b", F.explode(F.array(home, home - 1 if direction == "prior" else home + 1)))
    on = [F.col(k) == F.col(f"c_{k}") for k in keys] + [F.col("t_b") == F.col("c_b")]
    gap = F.col(us) - F.col(f"c_{us}") if direction == "prior" else F.col(f"c_{us}") - F.col(us)
    pairs = t.join(c, on).where((gap >= 0) & (gap <= window_us))
    if same is not None:
        pairs = pairs.where(same)
    near = F.col(f"c_{us}").desc() if direction == "prior" else F.col(f"c_{us}").asc()
    w = Window.partitionBy("__id").orderBy(near, F.col(f"c_{tie}").asc())
    return pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__id", "t_b", "c_b")


class Ranked:
    """Numbers in order, in blocks of bounded length: adding one, or looking up a place, costs no more than the number of blocks."""

    BLOCK = 1000

    def __init__(self) -> None:
        self.blocks: list[list] = []
        self.n = 0

    def add(self, x: float) -> None:
        i = bisect_left(self.blocks, x, key=lambda b: b[-1])
        if i == len(self.blocks):
            i -= 1 if i else 0
            self.blocks = self.blocks or [[]]
        insort(self.blocks[i], x)
        self.n += 1
        if len(self.blocks[i]) > 2 * self.BLOCK:
            self.blocks[i : i + 1] = [self.blocks[i][: self.BLOCK], self.blocks[i][self.BLOCK :]]

    def at(self, place: int) -> float:
        for b in self.blocks:
            if place < len(b):
                return b[place]
            place -= len(b)
        raise IndexError(place)

    def quantile(self, share: float) -> float:
        """Interpolated between the inclusive ranks."""
        position = share * (self.n - 1)
        low, high = math.floor(position), math.ceil(position)
        return float(self.at(low)) if low == high else (high - position) * self.at(low) + (position - low) * self.at(high)


def prefix_quantiles(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, shares: Sequence[float], out: str = "q") -> DataFrame:
    """df with out (array of double, null in a group's first row): the quantiles of value in the rows before each row of its group.

    Groups stream through their tasks in order, each value is put in place once: near-linear in a group's rows, of which the task
    holds the values alone. Null values are counted nowhere; null keys are a group."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ranked = None, Ranked()
        for batch in batches:
            found = []
            for key, x in zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column(value).to_pylist()):
                if key != last:
                    last, ranked = key, Ranked()
                found.append([ranked.quantile(s) for s in shares] if ranked.n else None)
                if x is not None:
                    ranked.add(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def running(df: DataFrame, keys: Sequence[str], by: str, value: str, out: str, parts: int = 32) -> DataFrame:
    """df with out: the sum of value over the rows of the group whose `by` is at most the row's own.

    Groups are cut into ranges of by at estimated quantiles; each range's sum is carried to the ranges after it, and
    rows are summed inside their range alone. So no task holds a whole group, unless one value of by does. Null keys are a group."""
    cuts = df.groupBy(*keys).agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 1000).alias("__cuts")).select(F.struct(*keys).alias("__key"), "__cuts")
    ranged = df.withColumn("__key", F.struct(*keys)).join(cuts, "__key").withColumn("__part", F.size(F.filter("__cuts", lambda x: x < F.col(by)))).drop("__cuts")
    sums = ranged.groupBy("__key", "__part").agg(F.sum(value).alias("__held"))
    before = sums.select("__key", "__part", F.coalesce(F.sum("__held").over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__key", "__part").orderBy(by).rangeBetween(Window.unboundedPreceding, 0)
    return ranged.join(before, ["__key", "__part"]).withColumn(out, F.sum(value).over(inside) + F.col("__before")).drop("__key", "__part", "__before")


def expanding(df: DataFrame, keys: Sequence[str], order: Sequence[str]):
    """The rows before the current one in its group."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
