"""Token ids as length-delimited binary records, with a separate offset index.

A shard is a file of frames, each: length of the payload (u64), masked checksum of those
eight bytes (u32), payload, masked checksum of the payload (u32); all little-endian. The
checksum is CRC-32, masked by a rotation of 15 bits and a constant, so that a checksum of
data that hold checksums stays sound. The payload is the record's key (i64 and a byte that
tells null), then its ids as u16 or u32. Beside each shard lies an index file: the magic
and width, then the offset of each frame (u64), by which any record is read without its
neighbours.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Memo, Work, groups, worker_table
from tidewatch.llm.token_counts import load

MAGIC = b"TWIX"
MASK = 0xA282EAD8
MEMO_ITEMS = 800_000
PIECE = re.compile(r"[^ \t\n\r]+")
#: What takes a text out of the plain ones, and the pieces of plain texts in lower case.
UNPLAIN = re.compile("[^\x00-\x26\x28-\x7fÀ-ÖØ-öø-ÿ]|<\\|")
PLAIN_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+", re.ASCII)


def masked(data: bytes) -> int:
    x = zlib.crc32(data)
    return (((x >> 15) | (x << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_frame(file) -> bytes | None:
    """The next payload; None at the end. Raises ValueError where a checksum or length is wrong."""
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("a frame's length is damaged")
    body = file.read(struct.unpack("<Q", head[:8])[0] + 4)
    if len(body) < 4 or struct.unpack("<I", body[-4:])[0] != masked(body[:-4]):
        raise ValueError("a frame's payload is damaged")
    return body[:-4]


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """For any store that pyarrow reads; a path without a scheme is local."""
    if re.match(r"file:/", path):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Encoder:
    """Ids of texts, as the library gives them. No rule of the tokenizer (normalization, lower case,
    white space dropped, pattern, added tokens) reaches across ASCII white space, so each distinct
    word is encoded once for each worker, in a bounded table.

    In texts of ASCII and Latin-1 letters without apostrophes and "<|", the pattern's pieces are
    runs of letters, single digits and runs of other characters, each of which ends with a token
    that marks the end of a piece. Those are looked up in lower case; unknown ones are encoded
    joined by spaces and cut at the end marks."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.words, self.plain = load(path), Memo(MEMO_ITEMS // 2), Memo(MEMO_ITEMS)
        n = self.tokenizer.get_vocab_size()
        self.code = "H" if n <= 1 << 16 else "I"
        self.dtype = f"<u{array(self.code).itemsize}"
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for x, i in vocab.items() if x.endswith("</w>")]] = True

    def encode_all(self, texts: list[str]) -> list[bytes]:
        plain = [not UNPLAIN.search(x) for x in texts]
        pieces = [PLAIN_PIECE.findall(x.lower()) if y else PIECE.findall(x) for x, y in zip(texts, plain)]
        ids = iter(self.plain.look_up(list(chain.from_iterable(x for x, y in zip(pieces, plain) if y)), self._learn_plain))
        rest = iter(self.words.look_up(list(chain.from_iterable(x for x, y in zip(pieces, plain) if not y)), self._learn))
        return [b"".join(islice(ids if y else rest, len(x))) for x, y in zip(pieces, plain)]

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn(self, words: list[str]) -> list[bytes]:
        return [self._bytes(x.ids) for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_plain(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(pieces), 4096):
            some = pieces[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):  # a tokenizer of another kind
                out.extend(self._learn(some))
                continue
            data, size = ids.astype(self.dtype).tobytes(), int(self.dtype[-1])
            at = [0, *(cuts * size).tolist()]
            out.extend(data[x:y] for x, y in zip(at, at[1:]))
        return out


def encoder(path: str) -> Encoder:
    return worker_table(("records", path), lambda: Encoder(path))


class ShardWriter:
    """Writes one shard under a name of its own and renames it when it is whole, so a task that is run again replaces it."""

    def __init__(self, folder: str, shard: int, dtype: str) -> None:
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.to, self.own = f"{root}/shard-{shard:05d}", f"{root}/.{shard}-{uuid.uuid4().hex}"
        self.file, self.at, self.offsets, self.dtype = self.fs.open_output_stream(self.own), 0, [], dtype

    def add(self, key: int | None, ids: bytes) -> int:
        data = frame(struct.pack("<qB", key or 0, key is None) + ids)
        self.offsets.append(self.at)
        self.file.write(data)
        self.at += len(data)
        return self.offsets[-1]

    def close(self) -> None:
        self.file.close()
        with self.fs.open_output_stream(f"{self.own}.idx") as f:
            f.write(MAGIC + self.dtype[-1].encode() + np.array(self.offsets, "<u8").tobytes())
        self.fs.move(self.own, f"{self.to}.rec")
        self.fs.move(f"{self.own}.idx", f"{self.to}.idx")


def write_records(df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, n_shards: int | None = None) -> DataFrame:
    """Encodes each text, appends end_id and writes the shards; key ranges follow each other from shard to shard.

    Returns a lazy index (shard, doc_id, offset, n_tokens); running it writes the files.
    Null texts are empty (end_id alone), null keys come first, equal keys are ordered by their
    ids and stay in one shard. Ranges are by quantiles of the key column, read alone.
    """
    spark = df.sparkSession
    n = n_shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / n for i in range(1, n)] or [0.5], 100 * n).alias("q")).first()["q"] if n > 1 else None
    bounds = np.array(sorted(set(cuts or [])), np.int64)
    dtype = encoder(path).dtype
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            ids = [x + end for texts in groups(batch.column(1)) for x in one.encode_all(texts)]
            shards = [0 if k is None else int(np.searchsorted(bounds, k, "left")) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column(0), pa.array(ids, pa.binary())], ["shard", "doc_id", "ids"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: ShardWriter | None = None
        at = None
        for batch in batches:
            rows = []
            for shard, key, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if shard != at:
                    if out:
                        out.close()
                    out, at = ShardWriter(folder, shard, dtype), shard
                rows.append((shard, key, out.add(key, ids), len(ids) // int(dtype[-1])))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["shard", "doc_id", "offset", "n_tokens"])
        if out:
            out.close()

    given = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = given.mapInArrow(encode, "shard int, doc_id long, ids binary")
    ordered = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    return ordered.mapInArrow(write, "shard int, doc_id long, offset long, n_tokens long")


def read_at(folder: str, shard: int, i: int) -> tuple[int | None, np.ndarray]:
    """Record i of a shard by the offset index alone: (key, ids)."""
    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/shard-{shard:05d}.idx") as f:
        head = f.read(5)
        f.seek(5 + 8 * i)
        offset = struct.unpack("<Q", f.read(8))[0]
    with fs.open_input_file(f"{root}/shard-{shard:05d}.rec") as f:
        f.seek(offset)
        body = read_frame(f)
    return parse(body, f"<u{head[4:].decode()}")


def parse(body: bytes, dtype: str) -> tuple[int | None, np.ndarray]:
    key, null = struct.unpack_from("<qB", body)
    return (None if null else key), np.frombuffer(body, dtype, offset=9)


def read_records(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """All records of the shards (shard int, base long: the ids before it), in order and with checksums verified:
    doc_id, start, n_tokens, ids_crc32 (of the ids as u32)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{root}/shard-{shard:05d}.idx") as f:
                    head = f.read(5)
                if head[:4] != MAGIC:
                    raise ValueError(f"shard {shard}: no index")
                dtype = f"<u{head[4:].decode()}"
                with fs.open_input_stream(f"{root}/shard-{shard:05d}.rec") as raw:
                    rows = []
                    while (body := read_frame(raw)) is not None:
                        key, ids = parse(body, dtype)
                        rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return shards.select(F.col("shard").cast("int"), F.col("base").cast("long")).repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, n_shards: int | None = None) -> DataFrame:
    """Writes the records of df into the shared folder and reads them back."""
    spark = df.sparkSession
    work = Work(spark, "records")
    index = work.write(write_records(df, work.at("shards"), path, id_col, text_col, end_id, n_shards), "index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return read_records(spark, work.at("shards"), shards)
