"""Packing: sum-of-squares online packing of token sequences into fixed windows.

Documents are tokenised where they are read and packed in the same task, so
nothing is shuffled: a task is an online packer over its split. A document's
full windows stand alone; its last part goes to the fill level that leaves the
least sum of squared counts of partially filled windows, which a level array
tracks. When a split ends, the windows still open are topped up by cutting the
pieces of the emptiest of them, so that one padded window remains for a split.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END = 0
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: How a byte-level vocabulary splits a text before it merges (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space in a row from which the faster library is not asked: its matcher runs out of stack between 900,000 and 1,000,000.
LONG_RUN = 1 << 16
BLANK = re.compile(rf"\s{{{LONG_RUN}}}")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer file.

    A byte-level BPE file whose merges rank as its ids do is merged by a faster
    library from the same vocabulary. Texts with one of the file's special
    tokens or a run of white space at which that library breaks off, and files
    of another kind, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        self.model = tokenizer(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.fast = self._fast(json.loads(self.model.to_str()))

    def _fast(self, spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or spec.get("normalizer") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        to, vocab = byte_of(), model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        ranks = {bytes(to[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        import tiktoken

        return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if self.fast is None or any(s in text for s in self.special) or len(text) >= LONG_RUN and BLANK.search(text):
                ids = self.model.encode(text, add_special_tokens=False).ids
            else:
                ids = self.fast.encode_ordinary(text)
            ids.append(END)
            out.append(np.array(ids, dtype="<u4"))
        return out


class SumOfSquares:
    """Windows of one split: `counts[h]` open windows are filled to level h."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list[tuple]]] = {}

    def level(self, need: int) -> int:
        """The level whose window takes `need` tokens at the least sum of squares; 0 opens a window."""
        n = self.counts
        top = self.size - need
        cost = n[need : self.size + 1] - n[: top + 1]
        cost = cost * 2 + 2
        cost[0] = 2 * n[need] + 1 if need < self.size else 0
        cost[top] -= (2 * n[self.size] + 1) if top else 0  # a full window is no longer counted
        cost[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        least = int(cost.min())
        return int(np.flatnonzero(cost == least)[-1])  # on a tie the fuller window

    def place(self, piece: tuple) -> list[tuple] | None:
        """Put a piece (doc, start, ids, doc_tokens) away; a window that it fills comes back."""
        need = len(piece[2])
        at = self.level(need)
        window: list[tuple] = []
        if at:
            window = self.open[at].pop()
            self.counts[at] -= 1
        window.append(piece)
        if at + need == self.size:
            return window
        self.counts[at + need] += 1
        self.open.setdefault(at + need, []).append(window)
        return None

    def close(self) -> Iterator[list[tuple]]:
        """The open windows, the fullest topped up with cut pieces of the emptiest."""
        left = [(h, w) for h in sorted(self.open, reverse=True) for w in self.open[h]]
        spare: list[tuple] = []
        a, b = 0, len(left)
        while a < b:
            fill, window = left[a]
            a += 1
            while fill < self.size and (spare or a < b):
                if not spare:
                    b -= 1
                    spare = left[b][1]
                    continue
                doc, start, ids, total = spare.pop()
                take = min(len(ids), self.size - fill)
                window.append((doc, start, ids[:take], total))
                fill += take
                if take < len(ids):
                    spare.append((doc, start + take, ids[take:], total))
            yield window
        while spare:
            window, fill = [], 0
            while spare and fill < self.size:
                doc, start, ids, total = spare.pop()
                take = min(len(ids), self.size - fill)
                window.append((doc, start, ids[:take], total))
                fill += take
                if take < len(ids):
                    spare.append((doc, start + take, ids[take:], total))
            yield window


def pack_stream(docs: Iterator[tuple[int, np.ndarray]], size: int = WINDOW) -> Iterator[list[tuple]]:
    """Windows of pieces for one stream of (doc, ids)."""
    packer = SumOfSquares(size)
    for doc, ids in docs:
        total = len(ids)
        for start in range(0, total, size):
            piece = (doc, start, ids[start : start + size], total)
            if (window := packer.place(piece)) is not None:
                yield window
    yield from packer.close()


def pack(docs: DataFrame, path: str, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each row of `docs`, with its window and place there.

    Null and empty texts are the single end id. Repeated rows are packed each on
    its own. A null id stays null. Other columns are not read. An empty table
    gives no rows. `sequence_id` is the split's number and the window's within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        task = TaskContext.get()
        at = (task.partitionId() if task else 0) << 32

        def stream() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for low in range(0, len(ids), 256):
                    texts = [t or "" for t in batch.column(1).slice(low, 256).to_pylist()]
                    yield from zip(ids[low : low + 256], encoder.encode(texts))

        rows: list[tuple] = []
        for window in pack_stream(stream(), size):
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, at, offset))
                offset += len(ids)
            at += 1
            if len(rows) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=COLUMNS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=COLUMNS)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
