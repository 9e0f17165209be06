"""Token counts of whole texts, by overlapping windows that are spliced where both agree.

A text longer than a window is cut into overlapping windows, each encoded on its own with
character offsets. Two neighbouring encodings are spliced at a position p of their overlap
that is a token start in both and *stable*: the character before p is no white space and
the one at p is. The byte-level pre-tokenizer never matches across such a position in any
context, and what follows it is matched from p alone, so the tokens before p (from the left
window) and those from p on (from the right one) are those of the whole text. If an overlap
holds no such p, it is doubled, up to the whole left window, which then doubles itself: a text
without white space is encoded in whole.

Texts up to one window are cut at all their stable positions; each distinct piece is
encoded once per worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Memo, groups, worker_table

WINDOW = 1 << 15
OVERLAP = 1 << 8
LIMIT = 1024
MEMO_ITEMS = 800_000

#: A run of ASCII white space with what follows it: pieces of a text cut at its stable positions.
PIECE = re.compile(r"\s*\S+|\s+", re.ASCII)
#: White space beyond ASCII; a text with any is cut in windows or not at all.
WIDE_SPACE = re.compile("[\x85\xa0  -     　]")
STABLE = re.compile("(?<=[^\t-\r \x85\xa0  -     　])[\t-\r \x85\xa0  -     　]")


def load(path: str):
    """The tokenizer, single-threaded: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def check_stable(path: str) -> None:
    """Raises ValueError unless the splice rule holds for this tokenizer: byte-level with its own
    pattern, no normalizer, no prefix space, no added token with white space or that strips it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    strips = any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or [])
    if not plain or spec.get("normalizer") or strips or spec.get("truncation") or spec.get("padding"):
        raise ValueError(f"{path}: stable positions are proven for plain byte-level tokenizers only")


class Counter:
    """Counts the tokens of texts of any length; holds at most one window's encoding pair and a bounded memo."""

    def __init__(self, path: str, window: int = WINDOW, overlap: int = OVERLAP) -> None:
        if not 0 < overlap < window:
            raise ValueError("overlap must lie between 0 and window")
        check_stable(path)
        self.tokenizer, self.window, self.overlap = load(path), window, overlap
        self.memo = Memo(MEMO_ITEMS)
        self.widened = 0

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def count_all(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; the distinct pieces of all of them are encoded together."""
        plain = [i for i, x in enumerate(texts) if len(x) <= self.window and not WIDE_SPACE.search(x)]
        held = set(plain)
        out = {i: self.spliced(x) if len(x) > self.window else self._encoded([x])[0] for i, x in enumerate(texts) if i not in held}
        pieces = [PIECE.findall(texts[i]) for i in plain]
        counts = iter(self.memo.look_up(list(chain.from_iterable(pieces)), self._encoded))
        out.update((i, sum(islice(counts, len(x)))) for i, x in zip(plain, pieces))
        return [out[i] for i in range(len(texts))]

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _starts(self, text: str, a: int, b: int) -> np.ndarray:
        """The start of each token of text[a:b] encoded alone, in the text's characters."""
        offsets = self.tokenizer.encode(text[a:b], add_special_tokens=False).offsets
        return a + np.fromiter((x[0] for x in offsets), np.int64, len(offsets))

    def spliced(self, text: str) -> int:
        total, cut = 0, 0  # tokens that start before cut are counted
        a, b = 0, min(len(text), self.window)
        left = self._starts(text, a, b)
        while b < len(text):
            overlap, at = self.overlap, None
            while at is None and (start := max(a, b - overlap)) > a:
                low = max(start, cut)
                if STABLE.search(text, low + 1, b):
                    end = min(len(text), b + self.window)
                    right = self._starts(text, start, end)
                    at = self._common(text, left, right, low, b)
                if at is None:
                    overlap *= 2
                    self.widened += 1
            if at is None:  # the overlap is the whole left window: it is encoded again with as much text again
                b = min(len(text), b + max(b - a, self.window))
                left = self._starts(text, a, b)
                continue
            total += int(np.searchsorted(left, at) - np.searchsorted(left, cut))
            left, a, b, cut = right, start, end, at
        return total + int(len(left) - np.searchsorted(left, cut))

    @staticmethod
    def _common(text: str, left: np.ndarray, right: np.ndarray, low: int, high: int) -> int | None:
        both = np.intersect1d(left, right)
        both = set(both[(both > low) & (both < high)].tolist())
        return next((m.start() for m in STABLE.finditer(text, low + 1, high) if m.start() in both), None)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row.

    Texts over a window are counted by splicing, shorter ones by their distinct pieces, and those of
    one window with white space beyond ASCII at once. A null text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows are kept as they
    are, an empty table gives no rows, other columns are not read. Nothing is shuffled.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = worker_table(("counts", path, window, overlap), lambda: Counter(path, window, overlap))
        for batch in batches:
            n = [k for texts in groups(batch.column(1)) for k in one.count_all(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    given = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return given.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
