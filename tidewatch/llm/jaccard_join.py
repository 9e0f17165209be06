"""N-gram Jaccard join of documents on sets of word shingles, by signature trees.

Equal sets become one. Two sets with a Jaccard index of at least t share an element among the
first n - ceil(t n) + 1 elements of each in any fixed order of all shingles (prefix filter), so
sets meet in the lists of their prefix shingles. The order puts what a fixed-size sketch of
document frequencies finds frequent last, so common passages are hardly in prefixes.

Sets form signature trees, whose nodes hold the OR of their token bitmaps, the range of set sizes
and what tokens exceed bits; a dual traversal drops pairs of nodes whose maximum possible overlap
is too small. Bitmaps grow with the sets, so a tree holds sets of about one size, and trees of
different sizes meet at the smaller one's bitmaps.

In a first pass each set of a list is compared with the list's first one; verified links give
components. Lists whose sets are all in one component can join no others. In the rest, the trees
search all pairs across components; of lists with the same sets one is searched, and a list tells
only which components have a pair that the bounds leave. The full sets of two such components meet
once, whatever the lists they share, until one link is verified. So components are known. All links
lie inside them: a component's full sets meet once, its trees search all pairs, those left are
verified, and each set's links are counted where they are found. Long lists and large components
are dealt in pairs of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ROUTE_BITS, Work, among, groups, no_table, picked, routed, worker_table
from tidewatch.llm.components import components

WORDS, SIMILAR = 5, 80  # words of a shingle; least Jaccard index in hundredths
#: The sketch has a cell for so many shingles, within these bounds of its bits.
PER_CELL, SKETCH_BITS = 16, (16, 22)
FREQUENT = 2  # a sketch cell that holds so many times the mean counts as frequent
BITS = 2048  # of a signature
LEAF, FAN = 8, 8
BLOCK = 2048  # sets of a list that one tree search takes on each side
LOAD = 1 << 19  # shingles of a component's sets that one search takes on each side
MET = 200_000  # pairs of components that a task remembers
MIXED = np.iinfo(np.int64).min
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C55
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


class Shingler:
    """Sets of 64-bit shingle hashes of many texts at once, by array arithmetic over their bytes: a word's
    hash is a difference of prefix sums of bytes times powers of BASE, scaled back to the word's start."""

    def __init__(self) -> None:
        self.powers, self.inverse = self._table(BASE), self._table(pow(BASE, -1, 1 << 64))

    def _table(self, base: int, n: int = 1 << 16) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _room(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 2 * len(self.powers))
            self.powers, self.inverse = self._table(BASE, n), self._table(pow(BASE, -1, 1 << 64), n)

    def words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each word of the texts, which follow a space each."""
        b = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
        self._room(len(b) + 1)
        space = SPACES[b]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # words start and end here, in turn
        start, end = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.powers[: len(b)])])
        return start, end, mix((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * M1)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        raw = [x.encode("utf-8", "replace").translate(UPPER) for x in texts]
        start, _, flat = self.words(raw)
        rolled = mix(flat + M1)
        for i in range(1, WORDS):
            rolled = mix(rolled[:-1] * M1 + flat[i:]) if len(rolled) > 1 else rolled[:0]
        ends = np.cumsum([len(x) + 1 for x in raw]) + 1
        bounds = np.searchsorted(start, np.concatenate([[0], ends])).tolist()
        out = []
        for at, to in zip(bounds, bounds[1:]):
            n = to - at
            if n >= WORDS:
                x = np.sort(rolled[at : to - WORDS + 1])
                out.append(x[np.append(True, x[1:] != x[:-1])])
            else:  # the whole sequence; its length keeps it apart from shingles
                own = np.uint64(n)
                for x in flat[at:to]:
                    own = mix(np.array([own], np.uint64) * M2 + x)[0]
                out.append(np.array([own] if n else [], np.uint64))
        return out


def shingler() -> Shingler:
    """One for each worker process, for its tables of powers."""
    return worker_table(("shingles",), Shingler)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def bitmaps(sets: list[np.ndarray]) -> list[bytes]:
    """The signature of each set: a bit for each element, of at least BITS and four times its size (a power of two); halves fold onto each other."""
    out = []
    for x in sets:
        n = 1 << max(BITS.bit_length() - 1, (4 * len(x) - 1).bit_length())
        bits = np.zeros(n, np.uint8)
        bits[(mix(x ^ M1) & np.uint64(n - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def folded(bitmap: bytes, size: int = BITS // 8) -> np.ndarray:
    """A signature of fewer bytes: what it would be if it had been made so long."""
    x = np.frombuffer(bitmap, np.uint64)
    return x if len(bitmap) == size else np.bitwise_or.reduce(x.reshape(-1, size // 8), axis=0)


def digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), np.int64).reshape(-1, 2)


def prefix_size(n: int, similar: int) -> int:
    return n - -(-similar * n // 100) + 1


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def read_all(rows: DataFrame, bits: int) -> DataFrame:
    """Rows of two kinds from one pass: doc_id, n_shingles, set, digest and wide (signature) of each text; and, for each task, part and cells:
    counts of its shingles in 2**bits cells, in parts."""
    part = 1 << min(14, bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, np.int32)
        held: list[np.ndarray] = []

        def count() -> None:
            nonlocal own
            if held:
                own += np.bincount((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)
                held.clear()

        for batch in batches:
            sizes, marks, bits_ = [], [], []
            for texts in groups(batch.column(1)):
                sets = shingler().sets(texts)
                held.extend(sets)
                if len(held) > 4096 or sum(map(len, sets)) > 1 << 20:
                    count()
                sizes.extend(map(len, sets))
                marks.append(digests(sets))
                bits_.extend(bitmaps(sets))
            d, n = np.concatenate(marks) if marks else np.zeros((0, 2), np.int64), batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(bits_, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        count()
        cells = own.reshape(-1, part)
        keep = np.flatnonzero(cells.any(axis=1))
        nulls = [pa.nulls(len(keep), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*nulls, pa.nulls(len(keep), pa.binary()), pa.array(keep, pa.int32()), pa.array([packed(cells[i]) for i in keep], pa.binary())], names)

    names = ["doc_id", "n_shingles", "set", "digest", "wide", "part", "cells"]
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set long, digest long, wide binary, part int, cells binary")


def packed(cells: np.ndarray) -> bytes:
    """A byte that gives the width, then the counts in as few bytes as hold them all."""
    width = next(w for w in (1, 2, 4, 8) if cells.max() < 1 << (8 * w - (w == 8)))
    return bytes([width]) + cells.astype(f"<u{width}").tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def sketch(parts: DataFrame, bits: int) -> np.ndarray:
    """The sum of the parts over all tasks; of a fixed size wherever it goes."""
    part = 1 << min(14, bits)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + unpacked(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([packed(x) for x in sums.values()], pa.binary())], ["part", "cells"])

    n = (1 << bits) // part
    out = np.zeros((n, part), np.int64)
    for i, x in parts.repartition(n, "part").mapInArrow(add, "part int, cells binary").collect():
        out[i] += unpacked(x)
    return out.reshape(-1)


def postings(rows: DataFrame, counts: np.ndarray, similar: int) -> DataFrame:
    """shingle, set (64 bits of its digest), size of each prefix element of each set; copies seen before in the same task are left out."""
    spark = rows.sparkSession
    bits = int(len(counts)).bit_length() - 1
    mean = max(1.0, counts.mean())
    ranks = np.where(counts >= FREQUENT * mean, np.log2(np.maximum(counts, 1) / mean).astype(np.int64) + 1, 0).astype(np.uint8)
    held = spark.sparkContext.broadcast(ranks)  # of a fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = held.value, set()
        for batch in batches:
            for texts in groups(batch.column(1)):
                sets = [x for x in shingler().sets(texts) if len(x)]
                which, out, sizes = [], [], []
                for x, (a, b) in zip(sets, digests(sets).tolist() if sets else []):
                    if (a, b) in seen:
                        continue
                    if len(seen) < 1_000_000:
                        seen.add((a, b))
                    own = rank[(x >> np.uint64(64 - bits)).astype(np.int64)]
                    keep = x[np.argsort(own, kind="stable")[: prefix_size(len(x), similar)]] if own.any() else x[: prefix_size(len(x), similar)]
                    which.append(a)
                    out.append(keep)
                    sizes.append(len(x))
                n = [len(x) for x in out]
                flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([signed(flat), pa.array(np.repeat(np.array(which, np.int64), n)), pa.array(np.repeat(np.array(sizes, np.int32), n))], ["shingle", "set", "size"])

    return rows.mapInArrow(run, "shingle long, set long, size int")


def live(lists: DataFrame) -> DataFrame:
    """Of postings, those whose shingle leads at least two sets, with the first set of the list; streamed over sorted partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table("links")
        first: tuple | None = None  # shingle, set, size of the current list's head
        shown = False  # whether the head has been emitted
        last: tuple | None = None
        for batch in batches:
            a, s, z = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(a):
                continue
            same = np.zeros(len(a), bool)  # as the row before
            same[1:] = (a[1:] == a[:-1]) & (s[1:] == s[:-1])
            same[0] = last == (a[0], s[0])
            last = (a[-1], s[-1])
            a, s, z = a[~same], s[~same], z[~same]
            if not len(a):
                continue
            head = np.append(True, a[1:] != a[:-1])
            if first and first[0] == a[0]:
                head[0] = False
                if not shown:  # the head is put before its followers again
                    a, s, z, head = np.append(first[0], a), np.append(first[1], s), np.append(first[2], z), np.append(True, head)
                    carried = False
                else:
                    carried = True
            else:
                carried = False
            of = np.cumsum(head) - 1
            starts = np.flatnonzero(head)
            if carried:  # rows before the first head belong to the list of an earlier batch
                of, starts = of + 1, np.append(0, starts)
                hs, hz = s[starts], z[starts]
                hs[0], hz[0] = first[1], first[2]
            else:
                hs, hz = s[starts], z[starts]
            n = np.diff(np.append(starts, len(a)))
            many = n > 1
            if carried:
                many[0] = True
            keep = many[of]
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(s[keep]), pa.array(z[keep], pa.int32()), pa.array(hs[of][keep]), pa.array(hz[of][keep], pa.int32())], ["shingle", "set", "size", "head", "head_size"])
            first = (a[-1], hs[-1], hz[-1])
            shown = bool(many[-1])

    return lists.mapInArrow(run, "shingle long, set long, size int, head long, head_size int")


def near_sizes(a: str, b: str, similar: int) -> str:
    return f"100 * least({a}, {b}) >= {similar} * greatest({a}, {b})"


def full_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, sid, shingles of the wanted sets (set, digest, sid), from the texts of their documents sid.
    A bitmap of fixed size keeps most other texts from being hashed; the join is exact."""
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(routed(wanted, "sid"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ROUTE_BITS)).cast("int")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            own = batch.filter(pa.array(held[batch.column(2).to_numpy()]))
            sets = [x for texts in groups(own.column(1)) for x in shingler().sets(texts)]
            d = digests(sets)
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["sid", "set", "digest", "shingles"])

    some = rows.where("doc_id is not null").select("doc_id", "text", place.alias("place")).mapInArrow(run, "sid long, set long, digest long, shingles array<long>")
    return some.join(wanted, ["sid", "set", "digest"]).dropDuplicates(["set", "digest"]).select("set", "sid", "shingles")


def bounded(pairs: DataFrame, sets: DataFrame, work: Work, name: str, similar: int) -> DataFrame:
    """Of pairs (a, b of sets) those whose bitmaps and sizes allow the index; only bitmaps of sets in pairs are moved."""
    pairs = work.narrow(pairs, f"{name}-pairs")
    sets = work.write(picked(sets.select("set", "size", "wide"), pairs.select(F.explode(F.array("a", "b")).alias("set")), "set"), f"{name}-bitmaps")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, k, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                size = min(len(x), len(y))
                x, y = folded(x, size), folded(y, size)
                p, q, both = (int(np.bitwise_count(z).sum()) for z in (x, y, x & y))
                keep.append((100 + similar) * min(both + min(m - p, k - q), m, k) >= similar * (m + k))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    one = sets.select(F.col("set").alias("a"), F.col("size").alias("m"), F.col("wide").alias("x"))
    two = sets.select(F.col("set").alias("b"), F.col("size").alias("k"), F.col("wide").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "m", "k", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, distinct: DataFrame, rows: DataFrame, work: Work, name: str, similar: int) -> DataFrame:
    """u, v (documents) of the pairs (a, b of sets) whose Jaccard index is high enough, on the full sets, which are read from the texts again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(distinct.where("sid is not null"), "set").select("set", "digest", "sid")
    sets = work.write(full_sets(rows, work.narrow(wanted, f"{name}-wanted")), f"{name}-sets")
    one = sets.select(F.col("set").alias("a"), F.col("sid").alias("u"), F.col("shingles").alias("x"))
    two = sets.select(F.col("set").alias("b"), F.col("sid").alias("v"), F.col("shingles").alias("y"))
    both = pairs.join(one, "a").join(two, "b").where("u <> v")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= similar * (F.size("x") + F.size("y") - shared)).select("u", "v")


# -- signature trees --


class Tree:
    """Levels of nodes over sets sorted by size, from leaves of LEAF sets up to one root. A node holds the OR of its
    bitmaps (all of one length), the range of sizes, the most that tokens exceed bits, and the one component of its sets (or MIXED)."""

    def __init__(self, sets: np.ndarray, sizes: np.ndarray, bitmaps: np.ndarray, comps: np.ndarray) -> None:
        order = np.lexsort((sets, comps, sizes))
        self.sets, self.sizes, self.bitmaps, self.comps = sets[order], sizes[order], bitmaps[order], comps[order]
        self.shorter: dict[int, Tree] = {}
        excess = self.sizes - np.bitwise_count(self.bitmaps).sum(axis=1)
        self.levels = [(self.bitmaps, self.sizes, self.sizes, excess, self.comps)]
        fan = LEAF
        while len(self.levels[-1][1]) > 1:
            b, low, high, e, c = self.levels[-1]
            at = np.arange(0, len(low), fan)
            one = np.minimum.reduceat(c, at) == np.maximum.reduceat(c, at)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(e, at), np.where(one, c[at], MIXED)))
            fan = FAN

    def folded(self, words: int) -> Tree:
        """The tree with bitmaps of so many 64-bit words, or fewer if it has fewer."""
        if words >= self.bitmaps.shape[1]:
            return self
        if words not in self.shorter:
            self.shorter[words] = Tree(self.sets, self.sizes, np.bitwise_or.reduce(self.bitmaps.reshape(len(self.sets), -1, words), axis=1), self.comps)
        return self.shorter[words]

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes of a level, and the index of the parent of each."""
        fan = LEAF if level == 1 else FAN
        kids = nodes[:, None] * fan + np.arange(fan)
        ok = kids < len(self.levels[level - 1][1])
        return kids[ok], np.nonzero(ok)[0]


def plant(sets: np.ndarray, sizes: np.ndarray, bitmaps: list[bytes], comps: np.ndarray) -> list[Tree]:
    """A tree for each length of bitmaps."""
    lengths = np.array([len(x) for x in bitmaps])
    out = []
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        out.append(Tree(sets[own], sizes[own], np.frombuffer(b"".join(bitmaps[i] for i in own), np.uint64).reshape(len(own), -1), comps[own]))
    return out


def meet(one: list[Tree], two: list[Tree], similar: int, apart: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of the trees of either side that the bounds leave; for one side with itself each pair once."""
    for k, x in enumerate(one):
        for y in two[k:] if one is two else two:
            words = min(x.bitmaps.shape[1], y.bitmaps.shape[1])
            yield from dual(x.folded(words), y.folded(words), similar, apart)


def dual(one: Tree, two: Tree, similar: int, apart: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of sets (of different components, if apart) that the bounds leave; for one tree with itself each pair once."""
    own = one is two
    stack = [(len(one.levels) - 1, len(two.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        i, j, x, y = stack.pop()
        bx, lx, hx, ex, cx = (v[x] for v in one.levels[i])
        by, ly, hy, ey, cy = (v[y] for v in two.levels[j])
        ok = (100 * hx >= similar * ly) & (100 * hy >= similar * lx)
        if apart:
            ok &= (cx != cy) | (cx == MIXED)
        if own and i == j:
            ok &= x <= y
        shared = np.zeros(len(x), np.int64)
        shared[ok] = np.bitwise_count(bx[ok] & by[ok]).sum(axis=1)
        most = np.minimum(shared + np.minimum(ex, ey), np.minimum(hx, hy))
        ok &= (100 + similar) * most >= similar * (lx + ly)
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        if i == 0 and j == 0:
            ok = x != y if own else np.ones(len(x), bool)
            yield one.sets[x[ok]], two.sets[y[ok]]
            continue
        if i >= j:
            x, parent = one.children(i, x)
            y, i = y[parent], i - 1
            if own and i + 1 == j:  # both step down together, so that each pair stays ordered
                y, parent = two.children(j, y)
                x, j = x[parent], j - 1
        else:
            y, parent = two.children(j, y)
            x, j = x[parent], j - 1
        few = max(64, (1 << 21) // bx.shape[1])  # 16 MB of bitmaps at once
        for k in range(0, len(x), few):
            stack.append((i, j, x[k : k + few], y[k : k + few]))


def tree_pairs(mixed: DataFrame, similar: int, block: int = BLOCK) -> DataFrame:
    """low, high: components of which two sets share a mixed list and pass the trees' bounds, once for each list at most
    and mostly once for a task. mixed: shingle, set, size, comp, bitmap, n (sets of the list)."""
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("set"), n_blocks).cast("int")
    dealt = mixed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    dealt = dealt.select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "size", "comp", "bitmap")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table("links")
        met: set[tuple[int, int]] = set()

        def search(rows: list[tuple]) -> pa.RecordBatch:
            trees, comps = {}, {}
            for k in {r[3] for r in rows}:
                mine = list({r[4]: r for r in rows if r[3] == k}.values())
                comps[k] = np.array([r[6] for r in mine], np.int64)
                trees[k] = plant(np.arange(len(mine)), np.array([r[5] for r in mine], np.int64), [r[7] for r in mine], comps[k])
            i, j = rows[0][1], rows[0][2]
            found: set[tuple[int, int]] = set()
            if i in trees and j in trees:
                for a, b in meet(trees[i], trees[j], similar):
                    a, b = comps[i][a], comps[j][b]
                    found.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
            found -= met
            if len(met) < MET:
                met.update(found)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["low", "high"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != held[0][:3]:
                    yield search(held)
                    held = []
                held.append(row)
        if held:
            yield search(held)

    ordered = dealt.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    return ordered.mapInArrow(run, "low long, high long")


class Full:
    """Full sets, numbered, and their trees."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        flat, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.maps = bitmaps([x.view(np.uint64) for x in sets])
        self.held = np.zeros(len(flat), bool)

    def trees(self, at: np.ndarray) -> list[Tree]:
        return plant(at, self.sizes[at], [self.maps[x] for x in at], at)

    def links(self, one: list[Tree], two: list[Tree], similar: int, left: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """A set of one with all those of two that link with it (of one tree with itself each pair once), of each
        batch of pairs that the trees leave. Sets of two that are no longer left are passed over; the caller may change it."""
        sizes, ends, code, held = self.sizes, self.ends, self.code, self.held
        for a, b in meet(one, two, similar, apart=False):
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else []
            for at, to in zip(first, [*first[1:], len(a)]):
                x, ys = a[at], b[at:to]
                if left is not None:
                    ys = ys[left[ys]]
                    if not len(ys):
                        continue
                held[code[ends[x] - sizes[x] : ends[x]]] = True
                starts = np.cumsum(sizes[ys]) - sizes[ys]
                places = np.repeat(ends[ys] - sizes[ys] - starts, sizes[ys]) + np.arange(int(sizes[ys].sum()))
                shared = np.add.reduceat(held[code[places]].astype(np.int64), starts)
                held[code[ends[x] - sizes[x] : ends[x]]] = False
                yield x, ys[100 * shared >= similar * (sizes[x] + sizes[ys] - shared)]


def join_components(pairs: DataFrame, sets: DataFrame, work: Work, similar: int, load: int = LOAD) -> DataFrame:
    """u, v: of pairs of components (low, high) those with a link between sets of either; sets: comp, set, shingles.

    Of two components the larger is the hub; its sets meet those of all its partners together. A pair of blocks of
    either side is one search by trees; what they leave is verified on the full sets, of a partner until it is linked."""
    totals = work.narrow(sets.groupBy("comp").agg(F.sum(F.size("shingles")).alias("total")), "more-totals")
    one, two = (totals.select(F.col("comp").alias(x), F.struct("total", "comp").alias(f"{x}_load")) for x in ("low", "high"))
    hub, other = F.greatest("low_load", "high_load"), F.least("low_load", "high_load")
    sided = pairs.join(one, "low").join(two, "high").select(hub.comp.alias("hub"), hub.total.alias("total"), other.comp.alias("other"), other.total.alias("other_total"))
    blocks = lambda total: F.ceil(F.col(total) / load).cast("int")
    sided = work.write(sided, "more-sided")
    hubs = work.narrow(sided.groupBy("hub", blocks("total").alias("n_i")).agg(F.sum("other_total").alias("others")).select("hub", "n_i", blocks("others").alias("n_j")), "more-hubs")
    place = lambda n: F.pmod(F.xxhash64("set"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = sets.withColumnRenamed("comp", "hub").join(hubs, "hub").withColumn("j", every("n_j")).select("hub", place(F.col("n_i")).alias("i"), "j", F.col("hub").alias("comp"), "shingles")
    theirs = sets.join(sided.select("hub", F.col("other").alias("comp")).join(hubs, "hub"), "comp").withColumn("i", every("n_i")).select("hub", "i", place(F.col("n_j")).alias("j"), "comp", "shingles")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table("links")

        def search(hub: int, rows: list[tuple]) -> pa.RecordBatch:
            comps, found = np.array([r[0] for r in rows], np.int64), []
            mine, theirs = np.flatnonzero(comps == hub), np.flatnonzero(comps != hub)
            if len(mine) and len(theirs):
                full, left = Full([r[1] for r in rows]), np.ones(len(rows), bool)
                for _, ys in full.links(full.trees(mine), full.trees(theirs), similar, left):
                    for comp in np.unique(comps[ys]):
                        found.append(comp)
                        left[comps == comp] = False
            return pa.RecordBatch.from_arrays([pa.array([hub] * len(found), pa.int64()), pa.array(found, pa.int64())], ["u", "v"])

        held, key = [], None
        for batch in batches:
            for hub, i, j, comp, shingles in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1]):
                if key != (hub, i, j):
                    if held:
                        yield search(key[0], held)
                    held, key = [], (hub, i, j)
                held.append((comp, shingles.values.to_numpy()))
        if held:
            yield search(key[0], held)

    return mine.unionByName(theirs).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(run, "u long, v long")


def count_links(sets: DataFrame, similar: int, load: int = LOAD) -> DataFrame:
    """set, n (documents whose sets link with it) of the sets of components; sets: comp, set, copies (documents with
    the set), shingles, total (shingles of the component's sets). A pair of blocks of a component is one search by trees;
    what they leave is verified on the full sets. Links are counted where they are found: no row is made of one."""
    n_blocks = F.ceil(F.col("total") / load).cast("int")
    own = F.pmod(F.xxhash64("set"), n_blocks).cast("int")
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    dealt = dealt.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "copies", "shingles")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table("links")

        def search(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
            i, j = key[1:]
            full = Full([r[3] for r in rows])
            side = np.array([r[0] for r in rows])
            trees = {k: full.trees(np.flatnonzero(side == k)) for k in {r[0] for r in rows} & {i, j}}
            copies, found = np.array([r[2] for r in rows], np.int64), np.zeros(len(rows), np.int64)
            if i in trees and j in trees:
                for x, ys in full.links(trees[i], trees[j], similar):
                    found[x] += copies[ys].sum()
                    np.add.at(found, ys, copies[x])
            keep = np.flatnonzero(found)
            return pa.RecordBatch.from_arrays([pa.array([rows[x][1] for x in keep], pa.int64()), pa.array(found[keep])], ["set", "n"])

        held, key = [], None
        for batch in batches:
            for comp, i, j, own, one, copies, shingles in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1]):
                if key != (comp, i, j):
                    if held:
                        yield search(key, held)
                    held, key = [], (comp, i, j)
                held.append((own, one, copies, shingles.values.to_numpy()))
        if held:
            yield search(key, held)

    found = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(run, "set long, n long")
    return found.groupBy("set").agg(F.sum("n").alias("n"))


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR, sketch_bits: int | None = None, block: int = BLOCK, load: int = LOAD, count: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and, with count, n_links (rows that link with it) of each row.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct runs of five
    words, or the whole sequence if there are fewer. Null and empty texts have empty sets and link
    with nothing. Repeated rows are copies of each other and count as links. Ids are cast to long and
    taken to be unique; an id that is no number fails under ANSI mode and is null otherwise. Classes of
    different texts whose least ids are equal are one. Rows with a null id keep it and get the least
    id of their equal texts' class; if there is none, null, and their texts link with their copies alone. An empty table gives no rows.
    """
    spark = df.sparkSession
    work = Work(spark, "jaccard")
    rows = _texts(df, id_col, text_col)

    if sketch_bits is None:  # by the bytes of all texts; a shingle starts about every six of them
        total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        sketch_bits = min(max((total // (6 * PER_CELL)).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    read = work.write(read_all(rows, sketch_bits), "read")
    docs = work.write(read.where("part is null").select("doc_id", "n_shingles", "set", "digest"), "docs")
    distinct = read.where("part is null and n_shingles > 0").groupBy("set", "digest").agg(F.min("doc_id").alias("sid"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("wide").alias("wide"))
    distinct = work.write(distinct, "distinct")
    counts = sketch(read.where("part is not null").select("part", "cells"), sketch_bits)
    work.drop("read")
    lists = work.write(live(postings(rows, counts, similar).repartition("shingle").sortWithinPartitions("shingle", "set")), "live")

    # First pass: each set with the head of its lists.
    heads = lists.where(f"set <> head and {near_sizes('size', 'head_size', similar)}").select(F.col("head").alias("a"), F.col("set").alias("b")).distinct()
    heads = work.narrow(bounded(heads, distinct, work, "heads", similar), "heads")
    edges = work.write(verified(heads, distinct, rows, work, "heads", similar), "edges")
    comps = work.write(components(edges, work, "first"), "comps")

    # Second pass: the other pairs, across components, in lists that hold several. Lists of the same sets are one.
    named = distinct.where("sid is not null").join(comps, F.col("sid") == F.col("node"), "left").select("set", F.coalesce("component", "sid").alias("comp"))
    member = work.write(lists.where("set <> head").select("shingle", "set", "size").join(named, "set"), "members")
    work.drop("live")
    same = [F.expr("bit_xor(xxhash64(set))").alias("h1"), F.expr("bit_xor(xxhash64(set, 7L))").alias("h2")]
    lots = member.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), *(f("set").alias(k) for f, k in ((F.min, "a"), (F.max, "b"))), F.min("size").alias("least"), F.max("size").alias("most"), *same).where("low < high")
    lots = work.write(lots.groupBy("n", "a", "b", "least", "most", "h1", "h2").agg(F.min("shingle").alias("shingle"), F.min("low").alias("low"), F.max("high").alias("high")), "lots")
    two = lots.where(f"n = 2 and {near_sizes('least', 'most', similar)}").select("a", "b", "low", "high").distinct()  # a list of two is one pair
    mixed = work.narrow(member.join(lots.where("n > 2").select("shingle", "n"), "shingle"), "mixed")
    maps = work.write(picked(distinct.where("sid is not null").select("set", "wide"), mixed, "set"), "mixed-bitmaps")
    two_pairs = bounded(two.select("a", "b"), distinct, work, "two", similar).join(two, ["a", "b"]).select("low", "high")
    pairs = two_pairs.unionByName(tree_pairs(mixed.join(maps.withColumnRenamed("wide", "bitmap"), "set"), similar, block))
    pairs = work.narrow(pairs.distinct(), "pairs")
    across = work.write(mixed.select("set").unionByName(two.select(F.explode(F.array("a", "b")).alias("set"))).distinct(), "across")
    ends = pairs.select(F.explode(F.array("low", "high")).alias("comp")).distinct()
    wanted = picked(distinct.where("sid is not null").select("set", "digest", "sid"), across, "set").join(across, "set")
    wanted = wanted.join(comps, F.col("sid") == F.col("node"), "left").select("set", "digest", "sid", F.coalesce("component", "sid").alias("comp")).join(ends, "comp", "left_semi")
    wanted = work.narrow(wanted, "more-wanted")
    sets = work.write(full_sets(rows, wanted.select("set", "digest", "sid")), "more-sets")
    more = work.write(join_components(pairs, sets.join(wanted.select("set", "comp"), "set"), work, similar, load), "more")
    every = work.write(components(edges.unionByName(more), work, "all"), "all")
    named = distinct.join(every, F.col("sid") == F.col("node"), "left").select("set", "digest", F.coalesce("component", "sid").alias("component_id"))
    columns = ["doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")]
    if count:  # every set that has a link was read for verification in one of the passes
        full = spark.read.parquet(work.at("heads-sets"), work.at("more-sets")).dropDuplicates(["set"]).select("set", "sid", "shingles")
        inside = full.join(every, F.col("sid") == F.col("node")).join(distinct.where("sid is not null").select("set", "copies"), "set").select(F.col("component").alias("comp"), "set", "copies", "shingles")
        inside = work.write(inside, "inside")
        totals = work.narrow(inside.groupBy("comp").agg(F.sum(F.size("shingles")).alias("total")), "totals")
        linked = work.write(count_links(inside.join(totals, "comp"), similar, load), "linked")
        named = named.join(distinct.select("set", "digest", "copies"), ["set", "digest"]).join(linked, "set", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("n", F.lit(0)))
        columns.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    for x in ("members", "lots", "mixed", "mixed-bitmaps", "across", "inside", "heads-pairs", "heads-bitmaps", "heads-wanted", "heads-sets", "two-pairs", "two-bitmaps", "more-wanted", "more-sets", "more-totals", "more-sided", "more-hubs"):
        work.drop(x)
    return docs.join(named, ["set", "digest"], "left").select(columns)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of df without those that link reaches from a smaller id; all columns and nothing else.

    Of rows that repeat an id that stays, one is kept. Rows with a null id can't be told apart and
    stay, as do rows without words. Only rows that a bitmap of fixed size lets through, which are
    those to drop and a few more, are moved to meet the ids to drop; all others pass.
    """
    work = Work(df.sparkSession, "keep")
    told = work.write(link(df, id_col, text_col, count=False, **how).where("doc_id is not null"), "told")
    drop = work.write(told.where("doc_id <> component_id").select(F.col("doc_id").alias("__drop")).distinct(), "drop")
    near = among(drop, ["__drop"], [F.col(id_col).cast("long")])
    out = df.where(~near).unionByName(df.where(near).join(drop, F.col(id_col) == F.col("__drop"), "left_anti"))
    again = told.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    again = work.write(again, "again")
    if again.limit(1).count():
        several = out.join(again, F.col(id_col) == F.col("__again"), "left_semi").dropDuplicates([id_col])
        out = out.join(again, F.col(id_col) == F.col("__again"), "left_anti").unionByName(several)
    return out
