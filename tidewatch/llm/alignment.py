"""Which tokens of two tokenizers cover the same bytes of a text.

A: a byte-level BPE read by `tokenizers`, over a space and the text. B: a SentencePiece model with byte
fallback, over the text (it adds the space). Neither lets a token cross from the end of a word into white space, so a
text is cut into chunks (white space and the word after it), each of which has the same tokens wherever it is
met. The relational steps run on the columns of all chunks that a worker meets for the first time, at once, not on
rows of all occurrences: tokens with chunk and position (posexplode); running sums of their lengths; ends of both
sides joined on (chunk, end); running counts of the cuts as group numbers; and for links a range join: each
different end of either side closes one range that one token of A and one of B cover, so links are as many as ends. Every text is
then put together from its chunks in order.

What needs the corpus is Spark's: id pairs are counted by documents, an A id's greatest count is
joined to its pairs, and texts get the sums over their links. The HOT commonest pairs are broadcast (at most 20 bytes each);
links with others are joined by a shuffle.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import pieces
from tidewatch.llm.common import Work, worker_table
from tidewatch.llm.common import groups as groups_of

#: White_Space of Unicode, which is what the pattern of A takes for white space (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = re.compile(f"(?<=[^{SPACE}])(?= )")
#: Chunks that a worker's table holds.
TABLE_ITEMS = 250_000
#: Pairs whose counts are broadcast.
HOT = 1 << 18
#: A pair is A's id times this, plus B's.
WIDE = 1 << 32


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones of Latin-1 stand for themselves, the others follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Recent(dict):
    """What is known of the chunks met lately: a table of at most `items` chunks or `chars` characters (and those of one call), and the one before it, whose chunks are taken over when they are met again."""

    def __init__(self, items: int, chars: int = 1 << 24) -> None:
        self.items, self.chars, self.held, self.before = items, chars, 0, {}

    def look_up(self, words: list[str], learn: Callable[[list[str]], list]) -> list:
        found = list(map(self.get, words))
        if None in found:
            unknown = list({w: None for w, x in zip(words, found) if x is None})
            held = list(map(self.before.get, unknown))
            self.held += sum(map(len, unknown))
            self.update((w, x) for w, x in zip(unknown, held) if x is not None)
            unknown = [w for w, x in zip(unknown, held) if x is None]
            self.update(zip(unknown, learn(unknown)))
            gc.freeze()  # the tables' many entries are no garbage; they needn't be walked again
            found = list(map(self.__getitem__, words))
        if len(self) > self.items or self.held > self.chars:
            self.before, self.held = dict(self), 0
            self.clear()
        return found


class Aligner:
    """Both tokenizers and a bounded table of aligned chunks. A chunk's entry: tokens of A, of B, groups, links; the groups as text; the pairs
    of all links. It is empty where the bytes of a side are not the chunk's."""

    def __init__(self, bytes_path: str, pieces_path: str, ranks_path: str | None) -> None:
        from tokenizers import Tokenizer

        pieces.check_model(pieces_path)
        self.a, self.b = Tokenizer.from_file(bytes_path), pieces.load(pieces_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        own, vocabulary = byte_of(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for x, i in vocabulary.items():
            self.a_bytes[i] = bytes(own[c] for c in x) if all(c in own for c in x) else x.encode()
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(pieces.MARK, " ").encode() for i, x in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_long, self.b_long = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.told = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), (",", ";", ""))) for end in ends for i in range(n)]
        self.mark = self.b.piece_to_id(pieces.MARK)
        self.ranks = _ranked(ranks_path) if ranks_path else None
        self.table = Recent(TABLE_ITEMS)

    def _of_a(self, chunks: list[str]) -> list[list[int]]:
        if self.ranks is None:
            return [x.ids for x in self.a.encode_batch(chunks, add_special_tokens=False)]
        plain = [x.isascii() for x in chunks]  # beyond ASCII the two libraries may know other letters
        rest = iter([x.ids for x in self.a.encode_batch([x for x, ok in zip(chunks, plain) if not ok], add_special_tokens=False)])
        return [self.ranks(x) if ok else next(rest) for x, ok in zip(chunks, plain)]

    def align(self, chunks: list[str]) -> list[tuple]:
        if not chunks:
            return []
        a = self._of_a(chunks)
        b = [y if len(x) > 1 else [self.mark] for x, y in zip(chunks, self.b.encode([x[1:] for x in chunks], num_threads=1))]  # B sets a space before what it is given
        raw = list(map(str.encode, chunks))
        same = [b"".join(map(self.a_bytes.__getitem__, x)) == z == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, z in zip(a, b, raw)]
        if not all(same):
            found = iter(self.align([x for x, ok in zip(chunks, same) if ok]))
            return [next(found) if ok else () for ok in same]
        chunk = np.arange(len(chunks))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(chunks)) for x in (a, b))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        a_ends, b_ends = np.cumsum(self.a_long[a_ids]), np.cumsum(self.b_long[b_ids])  # with all chunks end to end, an end tells its chunk too
        cuts, ends = np.intersect1d(a_ends, b_ends, assume_unique=True), np.union1d(a_ends, b_ends)
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)  # the cuts before a token's end
        pairs = a_ids[np.searchsorted(a_ends, ends)] * WIDE + b_ids[np.searchsorted(b_ends, ends)]
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        n_groups, n_links = (np.diff(np.searchsorted(x, stops, side="right"), prepend=0) for x in (cuts, ends))
        a_last, b_last = (np.append(np.diff(x) != 0, True).astype(np.int64) for x in (a_group, b_group))
        b_last[np.cumsum(n_b) - 1] = 2  # of its chunk
        said = np.concatenate([a_ids + a_last * len(self.a_bytes), b_ids + b_last * len(self.b_bytes) + 2 * len(self.a_bytes)])
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        told, at = list(map(self.told.__getitem__, said[order].tolist())), np.append(0, np.cumsum(n_a + n_b)).tolist()
        packed, to = pairs.tobytes(), np.append(0, 8 * np.cumsum(n_links)).tolist()
        return [(*n, "".join(told[at[i] : at[i + 1]]), packed[to[i] : to[i + 1]]) for i, n in zip(chunk.tolist(), zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist()))]

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """n_a, n_b, n_groups, n_links, digest of the groups, and the different pairs with how often each is linked."""
        parts = [CUT.split(" " + x) if x else [] for x in texts]
        each = iter(self.table.look_up(list(chain.from_iterable(parts)), self.align))
        for part in parts:
            found = list(islice(each, len(part)))
            if not found or () in found:
                yield 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32)
                continue
            n_a, n_b, n_groups, n_links, groups, links = zip(*found)
            pairs, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
            yield sum(n_a), sum(n_b), sum(n_groups), sum(n_links), hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs, times.astype(np.int32)


def _ranked(path: str) -> Callable[[str], list[int]]:
    """A's vocabulary as ranks, which is faster on short strings."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, f)}
    return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def aligner(bytes_path: str, pieces_path: str, ranks_path: str | None = None) -> Aligner:
    return worker_table(("alignment", bytes_path, pieces_path, ranks_path), lambda: Aligner(bytes_path, pieces_path, ranks_path))


def groups(text: str, bytes_path: str, pieces_path: str) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: ids of A and of B between two cuts."""
    one = aligner(bytes_path, pieces_path)
    found = one.table.look_up(CUT.split(" " + text), one.align) if text else []
    if () in found:
        return []
    return [tuple([int(i) for i in side.split(",")] for side in x.split("|")) for chunk in found for x in chunk[4].split(";")]


def _flat(lists: Iterable[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    lists = list(lists)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, lists))], pa.int32()), pa.array(np.concatenate([*lists, np.zeros(0, lists[0].dtype if lists else np.int64)]), kind))


def align(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, hot: int = HOT) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    n_links counts pairs of tokens whose byte ranges overlap. A pair of ids counts the rows that hold it linked, each
    once; count_sum adds up these counts over a row's links, n_best counts its links whose count is the
    greatest of their A id. Rows whose text is null, empty, or not given back byte for byte by both sides
    (as with U+2581, which B takes for a space) have zeros and an empty digest. Repeated rows and null ids are
    rows of their own, an empty table gives no rows, other columns are not read. ranks_path: A's vocabulary as ranks, with which
    chunks of ASCII are encoded faster.
    """
    spark, work = docs.sparkSession, Work(docs.sparkSession, "alignment")
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(bytes_path, pieces_path, ranks_path)
        for batch in batches:
            at = 0
            for texts in groups_of(batch.column(1)):
                part, at = batch.slice(at, len(texts)), at + len(texts)
                rows = list(one.texts(texts))
                counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([r[4] for r in rows]), _flat((r[5] for r in rows), pa.int64()), _flat((r[6] for r in rows), pa.int32())], ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    aligned = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")
    held = work.write(aligned.withColumn("row", F.monotonically_increasing_id()), "rows")
    counted = work.write(held.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("held")), "counts")
    greatest = counted.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("held").alias("most"))
    told = work.write(counted.withColumn("a", F.shiftright("pair", 32)).join(greatest, "a").select("pair", "held", (F.col("held") == F.col("most")).alias("best")), "told")
    hottest = told.orderBy(F.desc("held"), "pair").limit(hot).toArrow().combine_chunks()
    by_pair = np.argsort(hottest.column(0).to_numpy())
    shared = spark.sparkContext.broadcast(tuple(hottest.column(i).to_numpy()[by_pair] for i in range(3)))

    def known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in batches:
            lists, times = batch.column(1), batch.column(2).flatten().to_numpy()
            flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            hit = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            total = lambda x: np.bincount(row[hit], weights=x, minlength=batch.num_rows).astype(np.int64)
            # sums of weights are exact below 2 ** 53
            left = np.bincount(row[~hit], minlength=batch.num_rows)
            cut = np.cumsum(left)[:-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total(times[hit] * best[at[hit]])), pa.array(total(times[hit] * count[at[hit]])), _flat(np.split(flat[~hit], cut), pa.int64()), _flat(np.split(times[~hit], cut), pa.int32())], ["row", "n_best", "count_sum", "pairs", "times"])

    parts = work.write(held.select("row", "pairs", "times").mapInArrow(known, "row long, n_best long, count_sum long, pairs array<long>, times array<int>"), "known")
    rest = parts.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")).join(told, "pair")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("held")).alias("more"))
    out = held.drop("pairs", "times").join(parts.drop("pairs", "times"), "row").join(rest, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long").alias(a)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more"), "groups_sha256")
