"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays of what can repeat.

Of the 64-byte strings inside each window of LENGTH bytes, the one with the least hash (leftmost
of equals) is the window's anchor; equal windows have equal anchors at equal offsets. Windows
follow each other in runs with one anchor. Only runs whose anchor occurs again can repeat, and
of runs with equal bytes one stands for all; both are found by sorting runs by anchor.

What is left is told apart exactly by suffix arrays. A run is cut at fixed offsets from its
anchor into blocks of at most STEP windows; all windows of a block share its core, so blocks
meet by core, and the core can stand as one symbol. Strings of (bytes before the core, core,
bytes after it) are sorted together by linear grouping over Lyndon prefixes (lyndon.py), and
windows that repeat are neighbours in that order.

Passages are also found by words, whatever their bytes: each word is a symbol of UNIT bytes, its
hash, and windows are WINDOW words; of the windows found, those that start with a word count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Work, among, free, no_table, picked
from tidewatch.llm.jaccard_join import Shingler, shingler
from tidewatch.llm.lyndon import repeated

LENGTH = 400
GRAM = 64
STEP = 16
#: Words of a window where passages are found by words: a passage of over 50 words has so many whole ones even if both its ends touch other letters.
WINDOW = 49
#: Bytes of a word's symbol.
UNIT = 8
#: Distinct strings about one core that a task sorts together; beyond it, single windows are counted instead.
MOST = 8192
#: Symbols that are sorted in one go.
BATCH = 60_000
#: Long texts are hashed in parts of so many bytes.
PART = 1 << 22
#: Runs, and digests of texts, that a task remembers.
HELD = 200_000
PLACE = np.uint64((1 << 24) - 1)


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of `gram` (a power of two) symbols, doubled up from single ones; from eight at once where symbols are bytes."""
    if b.dtype == np.uint8 and gram >= 8:
        h, size = np.ndarray(len(b) - 7, "<u8", b, strides=1) * np.uint64(0x9E3779B97F4A7C15), 8
        h ^= h >> np.uint64(32)
    else:
        h, size = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while size < gram:
        right = h[size:] >> np.uint64(29)
        right ^= h[size:]
        h = h[:-size] * np.uint64(0xA0761D6478BD642F + 2 * size)
        h += right
        size *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def run_columns(b: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor's hash, its place, first and last window of each run of windows with one anchor, for the texts that b
    holds one after the other; bounds has the start of each and the end of the last. No window crosses texts."""
    wide = length - gram + 1
    begin, end = bounds[:-1], bounds[1:]
    none = np.maximum(begin, end - length + 1)  # from here on to its end a text has no windows
    whole = none > begin
    last = None
    keys, places, cuts = ([np.zeros(0, x)] for x in (np.uint64, np.int64, np.int64))
    for at in range(0, len(b) - length + 1, PART):
        h = gram_hashes(b[at : at + PART + length - 1], gram)
        n = len(h)
        x = h & ~PLACE
        x |= np.arange(n, dtype=np.uint64)  # of equal high bits the leftmost is least
        size = 1
        while 2 * size <= wide:
            x = np.minimum(x[:-size], x[size:])
            size *= 2
        x = np.minimum(x[: n - wide + 1], x[wide - size :][: n - wide + 1])
        place = (x & PLACE).astype(np.int64)
        opens = np.append(place[0] + at != last, place[1:] != place[:-1])
        last = place[-1] + at
        for i, j in zip(np.maximum(none - at, 0).tolist(), np.maximum(end - at, 0).tolist()):
            opens[i:j] = False
        opens[(begin - at)[whole & (begin >= at) & (begin < at + len(opens))]] = True
        cut = np.flatnonzero(opens)
        keys.append(h[place[cut]])
        places.append(place[cut] + at)
        cuts.append(cut + at)
    key, place, low = np.concatenate(keys).view(np.int64), np.concatenate(places), np.concatenate(cuts)
    high = np.minimum(np.append(low[1:], len(b)), none[np.searchsorted(begin, low, "right") - 1]) - 1 if len(low) else low
    return key, place, low, high


def runs(b: np.ndarray, length: int, gram: int) -> list[tuple[int, int, int, int]]:
    """run_columns() of one text of at least `length` bytes, as rows."""
    return list(zip(*(x.tolist() for x in run_columns(b, np.array([0, len(b)]), length, gram))))


def digests64(data: bytes, first: list[int], end: list[int]) -> np.ndarray:
    """A 64-bit digest of each of the strings of data between first and end."""
    return np.frombuffer(b"".join([blake2b(data[x:y], digest_size=8).digest() for x, y in zip(first, end)]), "<i8")


def symbols(raw: list[bytes], table: Shingler | None) -> tuple[bytes, np.ndarray]:
    """What windows are made of, and the bounds of each text in it: the bytes of texts, or the symbols of their words (white space is not told apart)."""
    if table is None:
        return b"".join(raw), np.cumsum([0, *map(len, raw)])
    start, _, flat = table.words(raw)
    return flat.tobytes(), np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in raw)]))


def _groups(column: pa.Array, size: int = 1 << 16) -> Iterator[tuple[int, list[bytes]]]:
    """Texts by some `size` bytes together, each with the number of the first."""
    own, n, at = [], 0, 0
    for i, x in enumerate(column):
        own.append(x.as_py())
        n += len(own[-1])
        if n >= size:
            yield at, own
            own, n, at = [], 0, i + 1
    if own:
        yield at, own


def anchored(texts: DataFrame, length: int, gram: int, unit: int = 1) -> DataFrame:
    """key, bytes (hash of the run's bytes), t1, t2, anchor, low, high of each run, with many (the task met the same
    run again) and again (it is such a further one); texts has t1, t2, raw.

    So a run that is found everywhere leaves a row or so in each task for the exchange by key; its further
    rows are known to repeat without it. A text seen before in the same task is left out; later steps don't need it.
    """

    kind = np.uint8 if unit == 1 else np.uint64

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table("repeats")
        table = shingler() if unit > 1 else None
        seen: set = set()
        held: list[np.ndarray] = []  # rows of RUN, as columns
        n = 0
        for batch in batches:
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids = list(zip(t1.tolist(), t2.tolist()))
            for at, raw in _groups(batch.column(2)):
                new = []
                for i, own in enumerate(ids[at : at + len(raw)]):
                    if own not in seen:
                        new.append(i)
                        if len(seen) < HELD:
                            seen.add(own)
                if not new:
                    continue
                data, bounds = symbols([raw[i] for i in new], table)
                key, a, low, high = run_columns(np.frombuffer(data, kind), bounds, length // unit, gram // unit)
                text = np.searchsorted(bounds, low, "right") - 1
                mark = digests64(data, (low * unit).tolist(), (high * unit + length).tolist())
                of, begin = np.array(new)[text] + at, bounds[text]
                held.append(np.stack([key, mark, t1[of], t2[of], (a - begin) * unit, (low - begin) * unit, (high - begin) * unit]))
                n += len(low)
                if n > HELD:
                    yield met(held)
                    held, n = [], 0
        if n:
            yield met(held)

    def met(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held, axis=1)
        rows = rows[:, np.lexsort((rows[1], rows[0]))]  # keeps the order of equal ones
        again = np.append(False, (rows[:2, 1:] == rows[:2, :-1]).all(axis=0))
        many = again | np.append(again[1:], False)
        return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(many), pa.array(again)], [x for x, _ in MET])

    return texts.where(F.octet_length("raw") >= least(length, unit)).mapInArrow(run, ddl(MET))


def least(length: int, unit: int) -> int:
    """The fewest bytes of a text with a window: words have a byte or more, and white space between them."""
    return length if unit == 1 else 2 * length // unit - 1


RUN = [(x, pa.int64()) for x in ("key", "bytes", "t1", "t2", "anchor", "low", "high")]
MET = [*RUN, ("many", pa.bool_()), ("again", pa.bool_())]
LIVE = [*RUN, ("head", pa.int64()), ("first", pa.bool_()), ("twin", pa.bool_())]
BLOCK = [("c1", pa.int64()), ("c2", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("key", pa.int64()), ("bytes", pa.int64()), ("offset", pa.int64())]
MARK = [("key", pa.int64()), ("bytes", pa.int64()), ("begin", pa.int64()), ("last", pa.int64())]
KINDS = {pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string"}


def ddl(kind: list) -> str:
    return ", ".join(f"{x} {KINDS[t]}" for x, t in kind)


def _batch(rows: list[tuple], kind: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in kind]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(cols, kind)], [x for x, _ in kind])


def live(all_runs: DataFrame) -> DataFrame:
    """Of runs (with many as a number), those whose anchor occurs again, streamed over partitions sorted by key: with the
    bytes of the list's first run (head), whether it is the first with its bytes, and whether others have the same (twin)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table("repeats")
        held: np.ndarray | None = None  # the last row, not yet out: what follows tells whether it is alive
        before: np.ndarray | None = None  # the row before it
        head = 0
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns]) if batch.num_rows else np.zeros((len(RUN) + 1, 0), np.int64)
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            if rows.shape[1] > 1:
                repeat = np.append(False, (rows[:-1, 1:] == rows[:-1, :-1]).all(axis=0))  # a run of a copy dealt to another task
                rows = rows[:, ~repeat]
            if not rows.shape[1]:
                continue
            out, head, before, held = _tell(rows, before, head, False)
            yield out
        if held is not None:
            yield _tell(held, before, head, True)[0]

    def _tell(rows: np.ndarray, before: np.ndarray | None, head: int, over: bool) -> tuple:
        own = rows if over else rows[:, :-1]
        n = own.shape[1]
        prior = np.concatenate([before if before is not None else own[:, :0], rows], axis=1)
        lead = prior.shape[1] - rows.shape[1]  # 1 if a row came before
        k, h = prior[0], prior[1]
        same_key = np.append(False, k[1:] == k[:-1])
        same = same_key & np.append(False, h[1:] == h[:-1])
        i = np.arange(n) + lead
        after_key = np.append(same_key[1:], False)[i]
        after = np.append(same[1:], False)[i]
        met = own[len(RUN)] > 0
        alive = same_key[i] | after_key | met
        heads = np.zeros(n, np.int64)
        starts = np.flatnonzero(~same_key[i])
        if n:
            of = np.cumsum(~same_key[i]) - 1
            heads = np.where(of < 0, head, own[1][starts[np.maximum(of, 0)]] if len(starts) else head)
            head = int(heads[-1])
        cols = [pa.array(x[alive]) for x in own[: len(RUN)]] + [pa.array(heads[alive]), pa.array(~same[i][alive]), pa.array((same[i] | after | met)[alive])]
        out = pa.RecordBatch.from_arrays(cols, [x for x, _ in LIVE])
        return out, head, own[:, -1:] if n else before, rows[:, -1:]

    return all_runs.mapInArrow(run, ddl(LIVE))


def cut_blocks(texts: DataFrame, length: int, step: int, unit: int = 1) -> DataFrame:
    """The blocks of runs: texts has raw and spans, an array of (key, bytes, anchor, low, high)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table("repeats")
        table = shingler() if unit > 1 else None
        for batch in batches:
            rows: list[tuple] = []
            cores: list[bytes] = []
            at, spans = batch.column(1).offsets.to_pylist(), batch.column(1).values
            all_ = list(zip(*(spans.field(x).to_pylist() for x in ("key", "bytes", "anchor", "low", "high"))))
            for i, raw in _groups(batch.column(0)):
                data, bounds = symbols(raw, table)
                for start, x, y in zip((bounds[:-1] * unit).tolist(), at[i:], at[i + 1 :]):
                    for key, own, a, low, high in all_[x:y]:
                        person = key.to_bytes(8, "little", signed=True)
                        for block in range((low - a) // step, (high - a) // step + 1):
                            b0, b1 = a + block * step, a + block * step + step - 1
                            first, last = max(low, b0), min(high, b1)
                            cores.append(blake2b(data[start + b1 : start + b0 + length], digest_size=16, salt=block.to_bytes(8, "little", signed=True), person=person).digest())
                            rows.append((data[start + first : start + b1], data[start + b0 + length : start + last + length], key, own, first - low))
                    if len(rows) > 20_000:
                        yield _blocks(cores, rows)
                        cores, rows = [], []
            yield _blocks(cores, rows)

    def _blocks(cores: list[bytes], rows: list[tuple]) -> pa.RecordBatch:
        c, own = np.frombuffer(b"".join(cores), "<i8").reshape(-1, 2), _batch(rows, BLOCK[2:])
        return pa.RecordBatch.from_arrays([pa.array(c[:, 0]), pa.array(c[:, 1]), *own.columns], [x for x, _ in BLOCK])

    return texts.select("raw", "spans").mapInArrow(run, ddl(BLOCK))


def sort_blocks(blocks: DataFrame, step: int, batch_symbols: int = BATCH) -> DataFrame:
    """key, bytes, begin and last (of windows that repeat, counted from the run's first) of the blocks that have any. Blocks come sorted by core."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table("repeats")
        groups: list[list[tuple]] = []  # lists of one core: (left, right, [(key, bytes, offset), ...])
        own: list[tuple] = []
        core: tuple | None = None
        n = 0
        for batch in batches:
            if batch.num_rows > 2:  # a core between two others is alone; what the ends of the batch are is not known yet
                c = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
                new = (c[:, 1:] != c[:, :-1]).any(axis=0)
                batch = batch.filter(pa.array(np.concatenate([[True], ~(new[:-1] & new[1:]), [True]])))
            for c1, c2, left, right, key, bytes_, offset in zip(*(c.to_pylist() for c in batch.columns)):
                if (c1, c2) != core:
                    if len(own) > 1 or own and len(own[0][2]) > 1:
                        groups.append(own)
                        n += sum(len(x[0]) + len(x[1]) + 2 for x in own)
                    core, own = (c1, c2), []
                    if n > batch_symbols:
                        yield _batch(mark(groups, step), MARK)
                        groups, n = [], 0
                if own and own[-1][0] == left and own[-1][1] == right:
                    own[-1][2].append((key, bytes_, offset))
                else:
                    own.append((left, right, [(key, bytes_, offset)]))
        if len(own) > 1 or own and len(own[0][2]) > 1:
            groups.append(own)
        yield _batch(mark(groups, step), MARK)

    return blocks.mapInArrow(run, ddl(MARK))


def mark(groups: list[list[tuple]], step: int) -> list[tuple]:
    """The rows of MARK. A window is `step` symbols that hold its core; bytes are symbols from 1, cores from 257, 0 ends a string."""
    symbols: list[int] = []
    starts: list[int] = []
    whose: list[tuple] = []
    masks: dict[int, int] = {}
    all_ = []
    for i, group in enumerate(groups):
        for left, right, owners in group:
            n = len(left) + len(right) + 2 - step  # windows of the block
            k = len(all_)
            all_.append(owners)
            if len(owners) > 1:
                masks[k] = (1 << n) - 1
            if len(group) > 1:
                at = len(symbols)
                starts.extend(range(at, at + n))
                whose.extend((k, j) for j in range(n))
                symbols.extend(x + 1 for x in left)
                symbols.append(257 + i)
                symbols.extend(x + 1 for x in right)
                symbols.append(0)
    for (k, j), hit in zip(whose, repeated(symbols, starts, step)):
        if hit:
            masks[k] = masks.get(k, 0) | 1 << j
    return [(key, own, offset + i, offset + j) for k, m in masks.items() for i, j in stretches(m) for key, own, offset in all_[k]]


@lru_cache(1 << 12)
def stretches(mask: int) -> list[tuple[int, int]]:
    """First and last of each run of set bits."""
    out, at = [], 0
    while mask:
        skip = (mask & -mask).bit_length() - 1
        mask >>= skip
        n = (~mask & (mask + 1)).bit_length() - 1
        out.append((at + skip, at + skip + n - 1))
        mask >>= n
        at += skip + n
    return out


def count_windows(blocks: DataFrame, step: int) -> DataFrame:
    """As sort_blocks, for cores with very many strings about them: each window is a row, counted by its bytes (partial sums)."""
    n = F.length("left") + F.length("right") + 2 - step
    j = F.explode(F.sequence(F.lit(0), n - 1))
    whole = F.concat("left", "right")
    each = blocks.withColumn("j", j).withColumn("window", F.substring(whole, F.col("j") + 1, F.lit(step - 1))).withColumn("before", F.length("left") - F.col("j"))
    twice = each.groupBy("c1", "c2", "before", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hits = each.join(twice, ["c1", "c2", "before", "window"])
    at = (F.col("offset") + F.col("j")).cast("long")
    return hits.select("key", "bytes", at.alias("begin"), at.alias("last"))


def cover(windows: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of bytes under windows given as ranges of starts (first, last)."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(windows):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def covered(first: np.ndarray, last: np.ndarray, length: int) -> list[tuple[int, int]]:
    """cover() of arrays."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(last[order]) + length
    opens = np.append(True, first[1:] > end[:-1])
    return list(zip(first[opens].tolist(), end[np.append(opens[1:], True)].tolist()))


def ranges(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """first and last of the windows of each row; none for a null."""
    at, own = column.offsets.to_numpy(), column.values
    first, last = own.field("first").to_numpy(), own.field("last").to_numpy()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield first[a:b], last[a:b]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges [start, end)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, step: int = STEP, most: int = MOST, work: Work | None = None, words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(texts, windows): texts has rep (an id), t1, t2 (digest of the text), n (rows with that text) and, with words, n_words;
    windows has t1, t2 and windows, an array of (first, last) ranges of window starts that repeat, for texts that occur once.
    With words, windows are so many words, and their starts are numbers of words."""
    unit = UNIT if words else 1
    length = words * UNIT if words else length
    if not 0 < step <= length - gram or gram & (gram - 1):
        raise ValueError("gram must be a power of two, and step at most length - gram")
    spark = df.sparkSession
    work = work or Work(spark, "repeats")
    text = F.coalesce(F.col(text_col), F.lit(""))
    half = lambda i: F.conv(F.substring(F.md5(text), i, 15), 16, 10).cast("long")
    texts = df.select(F.col(id_col).alias("doc_id"), half(1).alias("t1"), half(17).alias("t2"), F.encode(text, "UTF-8").alias("raw"))
    by_text = texts.where(F.octet_length("raw") >= least(length, unit)).groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"))
    known = work.write(by_text, "texts")
    found = work.write(anchored(texts.select("t1", "t2", "raw"), length, gram, unit), "runs")
    if words:  # not all of those texts have so many words
        known = work.write(known.join(found.groupBy("t1", "t2").agg((F.max("high") / unit + words).cast("long").alias("n_words")), ["t1", "t2"]), "known")
    lists = found.where("not again").select(*(x for x, _ in RUN), F.col("many").cast("long").alias("many"))
    further = found.where("again").select(*(x for x, _ in RUN), F.col("bytes").alias("head"), F.lit(False).alias("first"), F.lit(True).alias("twin"))
    alive = work.write(live(lists.repartition("key").sortWithinPartitions("key", "bytes", "t1", "t2", "low", F.col("many").desc())).unionByName(further), "live")
    work.drop("runs")
    # Anchors with several different runs: one run of each kind is cut into blocks.
    mixed = work.write(alive.where("first and bytes <> head").groupBy("key").agg((F.count("*") + 1).alias("n")), "mixed")
    reps = alive.where("first").join(mixed.select("key"), "key", "left_semi").join(known.select("t1", "t2", "rep"), ["t1", "t2"])
    spans = work.write(reps.groupBy("rep", "t1", "t2").agg(F.collect_list(F.struct("key", "bytes", "anchor", "low", "high")).alias("spans")), "spans")
    own = picked(texts.withColumnRenamed("doc_id", "rep"), spans, "rep", "t1", "t2")
    joined = own.join(spans, [own.rep.eqNullSafe(spans.rep), own.t1 == spans.t1, own.t2 == spans.t2]).select(own.t1, own.t2, "raw", "spans")
    single = joined.dropDuplicates(["t1", "t2"])
    blocks = work.write(cut_blocks(single, length, step, unit), "blocks")
    few, marks = blocks, None
    if mixed.where(F.col("n") > most).limit(1).count():  # a core's strings come from different runs with one anchor
        large = work.write(blocks.groupBy("c1", "c2").agg(F.count("*").alias("n")).where(F.col("n") > most).select("c1", "c2"), "large")
        few = blocks.join(large, ["c1", "c2"], "left_anti")
        marks = count_windows(blocks.join(large, ["c1", "c2"], "left_semi"), step)
    by_core = few.repartition("c1", "c2").sortWithinPartitions("c1", "c2", "left", "right").select([x for x, _ in BLOCK])
    marks = sort_blocks(by_core, step) if marks is None else sort_blocks(by_core, step).unionByName(marks)
    marks = work.write(marks, "marks")
    once = alive.join(known.where("n = 1").select("t1", "t2"), ["t1", "t2"], "left_semi")
    whole = once.where("twin").select("t1", "t2", F.col("low").alias("first"), F.col("high").alias("last"))
    part = once.where("not twin").join(marks, ["key", "bytes"]).select("t1", "t2", (F.col("low") + F.col("begin")).alias("first"), (F.col("low") + F.col("last")).alias("last"))
    both = whole.unionByName(part)
    if words:  # windows of whole symbols
        both = both.select("t1", "t2", F.ceil(F.col("first") / unit).alias("first"), F.floor(F.col("last") / unit).alias("last")).where("first <= last")
    windows = work.write(both.groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last")).alias("windows")), "windows")
    for x in ("live", "blocks", "spans", "marks", "mixed", "large"):
        work.drop(x)
    return known, windows


def _keyed(df: DataFrame, text_col: str, one: str = "__t1", two: str = "__t2") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    half = lambda i: F.conv(F.substring(F.md5(text), i, 15), 16, 10).cast("long")
    return df.withColumn(one, half(1)).withColumn(two, half(17))


def passage_words(windows: str, words: int) -> Column:
    """How many words lie under windows, an array of (first, last) ranges of starts of windows of so many words."""
    end = f"x.last + {words}L"
    step = f"named_struct('at', greatest(acc.at, {end}), 'n', acc.n + greatest(0L, {end} - greatest(acc.at, x.first)))"
    return F.expr(f"aggregate(array_sort({windows}), named_struct('at', 0L, 'n', 0L), (acc, x) -> {step}, acc -> acc.n)")


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, step: int = STEP, most: int = MOST, words: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row's text without the bytes of windows that repeat,
    and n_passage_words: how many of its words lie in windows of so many words that also start anywhere else (white space is not told apart).

    Texts are their UTF-8 bytes, null counts as empty, and no window crosses texts. Repeated rows
    are copies of each other: all of their windows repeat. Null ids are kept. An empty table gives
    no rows. Where a text occurs again, or has nothing to remove, its bytes are not moved.
    """
    work = Work(df.sparkSession, "repeats")
    known, windows = find_repeats(df, id_col, text_col, length, gram, step, most, work)
    also, by_words = find_repeats(df, id_col, text_col, most=most, work=Work(df.sparkSession, "repeats-words"), words=words)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = _keyed(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(text_col)), text_col).select("doc_id", F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha"))
    cut = removed(df, windows, text_col, length).select("t1", "t2", "n_removed", "n_spans", "kept_sha256")
    often = known.where("n > 1").select("t1", "t2", F.lit(True).alias("copied"))
    passages = by_words.select("t1", "t2", passage_words("windows", words).alias("n_passage_words")).unionByName(also.where("n > 1").select("t1", "t2", F.col("n_words").alias("n_passage_words")))
    told = often.join(cut, ["t1", "t2"], "full_outer").join(passages, ["t1", "t2"], "full_outer")
    out = rows.join(told, ["t1", "t2"], "left")
    copied = F.coalesce("copied", F.lit(False))
    return out.select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.coalesce("n_passage_words", F.lit(0)).alias("n_passage_words"),
    )


def removed(df: DataFrame, windows: DataFrame, text_col: str, length: int, words: int = 0) -> DataFrame:
    """t1, t2, n_removed, n_spans, kept_sha256 and kept (the text of whole remaining characters) of the texts with windows.
    With words, windows also has by_words, ranges of windows of so many words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = _keyed(df.select(F.col(text_col).alias(text_col)), text_col).select(F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), F.encode(text, "UTF-8").alias("raw"))
    both = picked(texts, windows, "t1", "t2").join(windows, ["t1", "t2"]).select("t1", "t2", "raw", "windows", *(["by_words"] if words else []))
    kind = [("t1", pa.int64()), ("t2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_table("repeats")
        table = shingler() if words else None
        for batch in batches:
            rows = []
            for t1, t2, raw, *own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), *map(ranges, batch.columns[3:])):
                data = raw.as_py()
                spans = covered(*own[0], length)
                if table and len(own[1][0]):
                    start, end, _ = table.words([data])  # after a space
                    spans = merged(spans + [(int(start[x]) - 1, int(end[y - 1]) - 1) for x, y in covered(*own[1], words)])
                edges = [0, *(y for x in spans for y in x), len(data)]
                left = [data[x:y] for x, y in zip(edges[::2], edges[1::2])]
                kept = b"".join(left)
                rows.append((t1, t2, len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), "".join(x.decode("utf-8", "ignore") for x in left)))
            yield _batch(rows, kind)

    return both.mapInArrow(run, ddl(kind))


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", length: int = LENGTH, words: int = 0, **how) -> DataFrame:
    """df with the repeated strings cut out of text_col, all columns and nothing else; size_col (where df
    has it) becomes the characters left. A character that is cut in part goes whole. Null texts stay null.
    With words, passages of so many words that repeat, with any white space, are cut too, of fewer bytes than length as well.
    Only rows with something to cut (and a few more that a bitmap lets through) are moved."""
    work = Work(df.sparkSession, "cut")
    known, windows = find_repeats(df, id_col, text_col, length, work=work, **how)
    if words:
        also, by_words = find_repeats(df, id_col, text_col, work=Work(df.sparkSession, "cut-words"), words=words)
        windows = work.write(windows.join(by_words.withColumnRenamed("windows", "by_words"), ["t1", "t2"], "full_outer"), "all-windows")
        known = known.where("n > 1").select("t1", "t2", "n").unionByName(also.where("n > 1").select("t1", "t2", "n")).distinct()
    *names, now = free(df, "__t1", "__t2", "__kept")
    cut = removed(df, windows, text_col, length, words).select(F.col("t1").alias(names[0]), F.col("t2").alias(names[1]), F.col("kept").alias(now))
    often = known.where("n > 1").select(F.col("t1").alias(names[0]), F.col("t2").alias(names[1]), F.lit("").alias(now))
    keyed = _keyed(df, text_col, *names)
    ids = windows.select("t1", "t2").unionByName(known.where("n > 1").select("t1", "t2"))
    some = among(ids, ["t1", "t2"], [F.col(x) for x in names])
    out = keyed.where(some).join(cut.unionByName(often), names, "left")
    out = out.withColumn(text_col, F.when(F.col(text_col).isNull() | F.col(now).isNull(), F.col(text_col)).otherwise(F.col(now)))
    if size_col and size_col in df.columns:
        out = out.withColumn(size_col, F.when(F.col(now).isNull(), F.col(size_col)).otherwise(F.length(text_col)).cast(df.schema[size_col].dataType))
    return keyed.where(~some).select(df.columns).unionByName(out.select(df.columns))
