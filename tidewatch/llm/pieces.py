"""SentencePiece encoding and decoding by a table of distinct marked chunks.

The model writes a space as a marker (U+2581), sets one before the text, and none of its
pieces holds a marker after another character. So no piece crosses from a chunk (a run of
markers with the characters up to the next one) into the next, merges inside a chunk never
depend on other chunks, and the ids of a text are those of its chunks in order. Each
distinct chunk is segmented once for each worker (a bounded table); ids are joined back by
position.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Memo, groups, worker_table

MARK = "▁"
CHUNK = re.compile(" +[^ ]*")
TABLE_ITEMS = 400_000


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def check_model(path: str) -> None:
    """Raises ValueError unless chunks are independent under this model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    free = spec.name == "identity" and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    if not free or model.trainer_spec.treat_whitespace_as_suffix or any(MARK in x.piece.lstrip(MARK) for x in model.pieces) or any(x.type == x.USER_DEFINED for x in model.pieces):
        raise ValueError(f"{path}: pieces can cross white space, or the model normalizes")


class ChunkTable:
    """Ids of texts through the distinct-chunk table."""

    def __init__(self, path: str) -> None:
        check_model(path)
        self.model, self.table = load(path), Memo(TABLE_ITEMS)
        self.mark = self.model.piece_to_id(MARK)
        self.code = "H" if self.model.get_piece_size() <= 1 << 16 else "I"

    def segment(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """The ids of chunks that start with a marker, each segmented alone, packed and as decimal text; the library sets their first marker."""
        given = [x[1:] for x in chunks]
        ids = [y if x else [self.mark] for x, y in zip(given, self.model.encode(given, num_threads=1))]
        return [(array(self.code, y).tobytes(), ",".join(map(str, y))) for y in ids]

    def chunks(self, texts: list[str]) -> list[list[tuple[bytes, str]]]:
        """For each text its chunks in order: ids packed, and as decimal text."""
        parts = [CHUNK.findall(" " + x.replace(MARK, " ")) if x else [] for x in texts]
        found = iter(self.table.look_up(list(chain.from_iterable(parts)), self.segment))
        return [list(islice(found, len(x))) for x in parts]

    def encode(self, text: str) -> list[int]:
        return self.ids(self.chunks([text])[0])

    def ids(self, chunks: list[tuple[bytes, str]]) -> list[int]:
        return array(self.code, b"".join([x[0] for x in chunks])).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def chunk_table(path: str) -> ChunkTable:
    return worker_table(("pieces", path), lambda: ChunkTable(path))


def encode_column(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """df with one more column, the ids (array of int) of text_col; a null text has none. An existing column of that name is replaced."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<int>")
    def ids(texts):
        one = chunk_table(path)
        return texts.map(lambda x: one.encode(x or ""))

    return df.withColumn(out, ids(text_col))


def digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text).

    A null text counts as empty (no ids, empty decoded text); null ids and repeated rows are kept,
    an empty table gives no rows, other columns are not read. Nothing is shuffled.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, sha = chunk_table(path), hashlib.sha256
        for batch in batches:
            n, encoded, decoded = [], [], []
            for chunks in (x for texts in groups(batch.column(1)) for x in one.chunks(texts)):
                ids = one.ids(chunks)
                n.append(len(ids))
                encoded.append(sha(",".join([c[1] for c in chunks]).encode()).hexdigest())
                decoded.append(sha(one.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
