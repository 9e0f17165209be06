"""Quality rules: base counts of words and lines, and the fertility of a public vocabulary.

Each distinct word is segmented once for each worker with the vocabulary (a bounded table of
arrays); a text is then the sequence of its words' numbers, and every measure is array
arithmetic over it. A text is rejected if a base rule fails or a fertility measure lies
outside the band of its language (or else of its script).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import free, groups, worker_table
from tidewatch.llm.pieces import load

SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
TABLE_WORDS = 400_000


@dataclass(frozen=True)
class Band:
    """Bounds of what is kept: characters of words per token, share of byte-fallback tokens, and
    entropy of the text's tokens in bits."""

    min_chars: float = 1.2
    max_chars: float = 8.0
    max_bytes: float = 0.10
    min_entropy: float = 4.0
    min_tokens: int = 64  # entropy says little of shorter texts

    def keeps(self, n_chars: int, n_tokens: int, n_bytes: int, entropy: float) -> bool:
        if not n_tokens:
            return False
        return self.min_chars * n_tokens <= n_chars <= self.max_chars * n_tokens and n_bytes <= self.max_bytes * n_tokens and (n_tokens < self.min_tokens or entropy >= self.min_entropy)


#: By language, then by script, then the rest. They reject what the vocabulary can't spell (codes, wrong languages, bytes) and
#: what repeats few tokens, not rare words. Scripts that it spells by single characters have fewer characters and less entropy a token.
BANDS = {
    "en": Band(min_chars=1.5), "de": Band(min_chars=1.4), "fr": Band(min_chars=1.4), "es": Band(min_chars=1.4), "latin": Band(min_chars=1.2),
    "cyrillic": Band(min_chars=1.0), "greek": Band(min_chars=0.6, min_entropy=3.5), "han": Band(min_chars=0.4, max_bytes=0.6, min_entropy=3.5),
    "arabic": Band(min_chars=0.6, min_entropy=3.2), "hebrew": Band(min_chars=0.6, min_entropy=3.0), "indic": Band(min_chars=0.4, max_bytes=0.5, min_entropy=3.2), "thai": Band(min_chars=0.5, max_bytes=0.3, min_entropy=3.2),
    "other": Band(min_chars=0.5, max_bytes=0.5, min_entropy=3.5),
}
SCRIPTS = {"latin": re.compile("[A-Za-zÀ-ɏ]"), "cyrillic": re.compile("[Ѐ-ӿ]"), "greek": re.compile("[Ͱ-Ͽ]"), "han": re.compile("[぀-ヿ㐀-鿿가-힯]"), "arabic": re.compile("[؀-ۿ]"), "hebrew": re.compile("[֐-׿]"), "indic": re.compile("[ऀ-෿]"), "thai": re.compile("[฀-๿]")}


def script(text: str) -> str:
    """The script with the most characters; other if there is none."""
    if text.isascii():
        return "latin" if re.search("[A-Za-z]", text) else "other"
    n = {k: len(x.findall(text)) for k, x in SCRIPTS.items()}
    best = max(n, key=n.get)
    return best if n[best] else "other"


class Numbers(dict):
    """Numbers words as they are first met."""

    def __init__(self) -> None:
        self.pending: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.pending.append(word)
        return n


class Words:
    """Numbers words and knows their characters, tokens and byte-fallback tokens."""

    def __init__(self, path: str) -> None:
        self.model = load(path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.chars = np.zeros(1024, np.int64)
        self.starts = np.zeros(1025, np.int64)  # of each word's tokens
        self.bytes_ = np.zeros(1024, np.int64)
        self.tokens = np.zeros(8192, np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > TABLE_WORDS:
            self.clear()
        found = list(map(self.number.__getitem__, words))
        if self.number.pending:
            self.learn(self.number.pending)
            self.number.pending = []
        return np.array(found, np.int64)

    def learn(self, words: list[bytes]) -> None:
        texts = [x.decode("utf-8", "replace") for x in words]
        k = len(self.number) - len(words)
        at = int(self.starts[k])
        ids = self.model.encode(texts, num_threads=1)
        sizes = np.array([len(x) for x in ids], np.int64)
        self.chars, self.bytes_, self.starts, self.tokens = (self.room(a, n) for a, n in ((self.chars, k + len(words)), (self.bytes_, k + len(words)), (self.starts, k + len(words) + 1), (self.tokens, at + int(sizes.sum()))))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
        self.tokens[at : at + len(flat)] = flat
        self.starts[k + 1 : k + 1 + len(words)] = at + np.cumsum(sizes)
        self.chars[k : k + len(words)] = [len(x) for x in texts]
        ends = np.concatenate([[0], np.cumsum(self.is_byte[flat])])
        own = self.starts[k : k + len(words) + 1] - at
        self.bytes_[k : k + len(words)] = ends[own[1:]] - ends[own[:-1]]

    @staticmethod
    def room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def repeated_words(ids: np.ndarray, size: int = 3) -> int:
    """Words inside windows of `size` words that are found twice or more, the first included."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    _, ids = np.unique(ids, return_inverse=True)
    key = np.zeros(n, np.int64)
    for i in range(size):  # renumbered after each step, so that no key overflows
        key = key * (int(ids.max()) + 1) + ids[i : i + n]
        if i + 1 < size and i:
            _, key = np.unique(key, return_inverse=True)
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = counts[where] > 1
    cover = np.zeros(len(ids), bool)
    for i in range(size):
        cover[i : i + n] |= hit
    return int(cover.sum())


def measure_all(texts: list[str], langs: list[str | None], words: Words, bands: dict[str, Band]) -> list[tuple]:
    """The values of COLUMNS for each text."""
    raw = [x.encode("utf-8", "replace").split() for x in texts]  # bytes split at ASCII white space only
    ids = words.numbers(list(chain.from_iterable(raw)))
    ends = np.cumsum([len(x) for x in raw])
    return [measure(x, own, words, lang, bands) for x, own, lang in zip(texts, np.split(ids, ends[:-1]), langs)]


def measure(text: str, ids: np.ndarray, words: Words, lang: str | None, bands: dict[str, Band]) -> tuple:
    """ids: the text's words in order, numbered by `words`."""
    n = len(ids)
    n_chars = int(words.chars[ids].sum()) if n else 0
    n_symbols = sum(text.count(x) for x in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    n_repeat = repeated_words(ids)
    failed = n < 50 or 100 * n_repeat > 50 * n
    n_tokens = n_bytes = 0
    entropy = 0.0
    if n:
        distinct, counts = np.unique(ids, return_counts=True)
        sizes = words.starts[distinct + 1] - words.starts[distinct]
        n_tokens, n_bytes = int((sizes * counts).sum()), int((words.bytes_[distinct] * counts).sum())
        if n_tokens > 1:
            places = np.repeat(words.starts[distinct] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
            p = np.bincount(words.tokens[places], np.repeat(counts, sizes))
            p = p[p > 0] / n_tokens
            entropy = float(-(p * np.log2(p)).sum())
    if failed:
        kept = False
    else:
        band = bands.get(lang or "") or bands.get(script(text)) or bands["other"]
        kept = band.keeps(n_chars, n_tokens, n_bytes, entropy)
    return n, n_chars, n_symbols, len(lines) - len(set(lines)), n_repeat, failed, kept, n_tokens, n_bytes, entropy


COLUMNS = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_tokens", pa.int64()), ("n_byte_tokens", pa.int64()), ("token_entropy", pa.float64()))
SQL_TYPES = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}


def score(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", bands: dict[str, Band] | None = None, keep: bool = False) -> DataFrame:
    """doc_id and the measures of each text, with base_failed and kept.

    A null text has no words (rejected), a null or unknown language takes the band of the text's
    script. Repeated rows and null ids are kept as they are; an empty table gives no rows. With
    keep, all columns of df come back for the rows that are kept and nothing else. Nothing is
    shuffled; a text is measured whole in the task that reads it.
    """
    held = {"other": Band()} | (BANDS if bands is None else bands)
    lang = F.col(lang_col) if lang_col and lang_col in df.columns else F.lit(None).cast("string")
    schema = df.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_table(("quality", path), lambda: Words(path))
        for batch in batches:
            i = batch.schema.names.index(text_at)
            j = batch.schema.names.index(lang_at)
            langs = iter(batch.column(j).to_pylist())
            rows = [r for texts in groups(batch.column(i)) for r in measure_all(texts, list(islice(langs, len(texts))), words, held)]
            if keep:
                mask = pa.array([r[6] for r in rows], pa.bool_())
                yield batch.filter(mask).select(schema.names)
            else:
                cols = list(zip(*rows)) or [[] for _ in COLUMNS]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, (_, t) in zip(cols, COLUMNS))], ["doc_id", *(x for x, _ in COLUMNS)])

    if keep:
        text_at, (lang_at,) = text_col, free(df, "__lang")
        return df.withColumn(lang_at, lang).mapInArrow(run, schema)
    text_at, lang_at = "text", "lang"
    kind = schema[id_col].dataType.simpleString()
    given = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"))
    return given.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} {SQL_TYPES[t]}" for x, t in COLUMNS))
