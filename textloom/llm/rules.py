"""Quality rules: hard limits, then a hashed n-gram logistic model.

The model sees hashed words, word pairs and 4-grams of code points, each as shares
of the text. It is trained on the driver from at most SAMPLE labelled rows per class,
calibrated on the half that the weights were not fitted on, and then scores all
texts in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import words
from textloom.llm.lmscore import Hashes
from textloom.llm.logit import labelled, platt, sigmoid, sparse

#: Labelled rows of each class that the model is fitted on, at most, and the bytes that such a text may have.
SAMPLE, FIT_BYTES = 500, 1 << 16
#: Rows of each class if a class has no text as short as that.
LONG_SAMPLE = 50
DIM = 1 << 16
SCALE = 30.0
#: A text is kept from this probability of good quality on.
THRESHOLD = 0.5
MIN_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
U = np.uint64
ODD, MIX = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)

COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def repeated(h: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in a window of words that the text holds twice or more."""
    if len(h) <= window:
        return 0
    step, p, x = 1, ODD, h
    while step < window:
        x = x[:-step] * p + x[step:]
        p, step = U(int(p) ** 2 & (1 << 64) - 1), step * 2
    s = np.sort(x)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(x, twice))
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def facts(text: str | None, w: list[bytes], h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    raw = text.encode()
    lines = [x for x in text.split("\n") if x.strip(SPACE.decode())]
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    return len(w), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(h)


def features(text: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of every word and pair, and of every 4 characters; pairs of equal words are one feature."""
    pairs = np.where(h[1:] == h[:-1], ODD, h[:-1] * ODD + h[1:]) >> U(48)
    own = np.concatenate([h >> U(48), pairs]).astype(np.int64) if len(h) else np.zeros(0, dtype=np.int64)
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(a) < 4:
        return own, np.zeros(0, dtype=np.int64)
    two = a[:-1] * MIX + a[1:]
    return own, (((two[:-2] * MIX + a[2:-1]) * MIX + two[2:]) * ODD >> U(48)).astype(np.int64)


def row(text: str | None, known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """A training row: the features' indices and their scaled shares; grams follow words."""
    own, grams = features(text or "", known.of(words(text)))
    at, v = [], []
    for shift, part in ((0, own), (DIM, grams)):
        idx, n = np.unique(part, return_counts=True)
        at.append(idx + shift)
        v.append(n * (SCALE / max(1, len(part))))
    return np.concatenate(at), np.concatenate(v)


class Model:
    def __init__(self, w: np.ndarray, a: float, b: float):
        self.words, self.grams, self.shift, self.a, self.b = w[:DIM], w[DIM : 2 * DIM], w[2 * DIM], a, b

    def probability(self, text: str, h: np.ndarray) -> float:
        own, grams = features(text, h)
        z = self.shift + SCALE * sum(float(w[at].mean()) for w, at in ((self.words, own), (self.grams, grams)) if len(at))
        return float(sigmoid(np.array([self.a * z + self.b]))[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE) -> Model | None:
    """The calibrated model, or none if the labels lack one of the classes.

    The sample is of texts of up to FIT_BYTES, so what the driver gets is bounded;
    where a class has none, LONG_SAMPLE rows of any length stand in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                part = batch.slice(low, 100)
                rows = [row(t, known) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([r[0].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary())],
                    names=["doc_id", "label", "at", "v"],
                )

    short = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) <= FIT_BYTES
    for rows, most in ((docs.where(short), per_class), (docs, min(per_class, LONG_SAMPLE))):
        got = labelled(rows, labels, "quality", most, id_col, text_col).mapInArrow(run, "doc_id long, label int, at binary, v binary").collect()
        got.sort(key=lambda r: (r[0], r[1]))
        y = np.array([r[1] for r in got], dtype=np.float64)
        if 0 < y.sum() < len(y):
            break
    if not 0 < y.sum() < len(y):
        return None
    rows = [(np.frombuffer(r[2], dtype="<i4"), np.frombuffer(r[3], dtype="<f4").astype(np.float64)) for r in got]
    half = np.zeros(len(y), dtype=bool)
    for c in (0, 1):
        half[np.flatnonzero(y == c)[::2]] = True
    if not 0 < y[~half].sum() < (~half).sum():
        half[:] = True
    share = {r[0]: r[1] for r in labels.where("quality in (0, 1)").groupBy("quality").count().collect()}
    w = sparse([r for r, k in zip(rows, half) if k], y[half], 2 * DIM)
    held = ~half if not half.all() else half
    z = np.array([float(v @ w[at]) + w[-1] for (at, v), k in zip(rows, held) if k])
    yh = y[held]
    weight = np.where(yh == 1, share.get(1, 1) / max(1, yh.sum()), share.get(0, 1) / max(1, (1 - yh).sum()))
    return Model(w, *platt(z, yh, weight * len(yh) / weight.sum()))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The facts of every row, whether it fails the hard limits, and whether it is kept.

    A null or empty text has no words and fails; texts of any length are read whole. Repeated rows come back as
    often, null ids as null. If the labels lack a class there is no model, the
    score is null, and the limits alone decide. Other columns are not read. An
    empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = Hashes(), shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                out = []
                for text in part.column(1).to_pylist():
                    w = words(text)
                    h = known.of(w)
                    n = facts(text, w, h)
                    failed = n[0] < MIN_WORDS or 100 * n[4] > MOST_REPEATED * n[0]
                    p = model.probability(text or "", h) if model else None
                    out.append((*n, failed, not failed and (p is None or p >= threshold), p))
                cols = list(zip(*out))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
                names = ["doc_id", *"n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept score".split()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, COLUMNS)
