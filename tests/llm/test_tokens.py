import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest

from tests.llm.fixtures import documents, empty, got, prose, rows, wanted
from tidewatch.llm import pieces, token_counts, token_records

BYTE, WORD, PIECE = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def test_counts_match_the_library(spark):
    tok = token_counts.load(BYTE)
    want = wanted((r[0], len((r[1] or "").encode()), n := len(tok.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in rows())
    assert got(token_counts.count_tokens(documents(spark), BYTE), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(empty(spark), BYTE).count() == 0


@pytest.mark.parametrize(("window", "overlap"), [(40, 4), (64, 16), (200, 50)])
def test_spliced_windows_match_the_library(window, overlap):
    one, rng = token_counts.Counter(BYTE, window, overlap), random.Random(window)
    texts = [prose(rng, rng.randrange(1, 300)) for _ in range(60)] + ["x" * 1000, " " * 700, "a" * 300 + " b" * 200, "\u00a0" * 300, "word " * 3 + "y" * 500 + " end" * 30]
    assert one.count_all(texts) == [len(one.tokenizer.encode(x, add_special_tokens=False).ids) for x in texts]
    assert one.widened > 0  # long runs without a stable position


def test_long_texts_without_white_space_end():
    """The number of encodings grows with the logarithm of the text, not with its characters."""
    rng = random.Random(5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    one, library = token_counts.Counter(path, 256, 16), token_counts.load(path)
    calls, starts = [], one._starts
    one._starts = lambda *a: calls.append(a) or starts(*a)
    text = "".join(rng.choice("abcdef0123") for _ in range(20_000)) + " and words again" * 50
    assert one.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(calls) < 40


def test_counts_refuse_other_tokenizers():
    with pytest.raises(ValueError, match="proven"):
        token_counts.Counter(WORD)
    with pytest.raises(ValueError, match="overlap"):
        token_counts.Counter(BYTE, 10, 10)


def test_records_round_trip(spark):
    tok = token_counts.load(WORD)
    ids = [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows()]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    want, start = [], 0
    for key, x in ids:
        want.append((key, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    for n in (None, 1, 7):
        assert got(token_records.round_trip(documents(spark), WORD, n_shards=n), "doc_id", "start", "n_tokens", "ids_crc32") == wanted(want)
    assert token_records.round_trip(empty(spark), WORD).count() == 0


def test_record_files(spark, tmp_path):
    index = token_records.write_records(documents(spark).where("doc_id is not null"), str(tmp_path), WORD, n_shards=3).orderBy("shard", "offset").collect()
    by_shard = {}
    for r in index:
        place = by_shard[r.shard] = by_shard.get(r.shard, -1) + 1
        key, ids = token_records.read_at(str(tmp_path), r.shard, place)
        assert (key, len(ids)) == (r.doc_id, r.n_tokens) and ids[-1] == 1
    path = next(tmp_path.glob("*.rec"))
    whole = bytearray(path.read_bytes())
    whole[20] ^= 1
    path.write_bytes(whole)
    with path.open("rb") as f, pytest.raises(ValueError, match="damaged"):
        while token_records.read_frame(f):
            pass
    assert not list(tmp_path.glob(".*")), "files under their own names are renamed"


def test_frames():
    data = token_records.frame(b"abc")
    assert struct.unpack("<Q", data[:8]) == (3,) and data[12:15] == b"abc"
    assert token_records.masked(b"abc") != zlib.crc32(b"abc")


def test_pieces_match_the_library(spark):
    model, want = pieces.load(PIECE), []
    for r in rows():
        ids = model.encode(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert got(pieces.digest(documents(spark), PIECE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == wanted(want)
    assert pieces.digest(empty(spark), PIECE).count() == 0
    some = pieces.encode_column(documents(spark).where("doc_id = 5"), PIECE).first()
    assert list(some.ids) == model.encode("two words")


def test_chunks_of_many_texts():
    table, rng = pieces.ChunkTable(PIECE), random.Random(1)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(300)] + ["", " ", "   ", "a", " a ", "▁", "▁a▁", "a  b   c    "]
    assert [table.encode(x) for x in texts] == table.model.encode(texts)


def test_memo_starts_anew():
    one = token_counts.Counter(BYTE)
    one.memo.items = 5
    texts = [f"word{i} other{i}" for i in range(20)]
    for x in texts:
        assert one.count(x) == len(one.tokenizer.encode(x).ids)
