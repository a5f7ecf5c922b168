"""LM scoring with a log-frequency Bloom filter.

A first pass reads texts in runs of about FLUSH_TOKENS tokens. A run sums up
its tokens, bigrams and trigrams, so that a frequent n-gram is one entry for
each run, and asks for them in the segments of the hash range, packed as arrays
that also carry how often the training texts of the run hold them. A segment sums
its entries exactly and builds its piece of the filter: an n-gram is entered at
the levels 1 to that of its count, so the quantised count is read back by
probing level after level until a probe fails. Levels are the counts themselves up
to EXACT and logarithmic beyond, FINE to a doubling. It probes all n-grams it was
asked for and answers each run with levels, and with the exact counts of its tokens.

The vocabulary is counted before, as probabilities need the number of all tokens
and of distinct ones. The answers meet their runs again, where whole texts are
scored and the base score is added up from the exact counts. The filter is never
in one place and not broadcast: it grows with its entries, a piece for each
segment, and every n-gram of the training texts is in it at any size of the table.

A token's probability after a context of count C, which the token follows q times,
is (q + PULL * lower) / (C + PULL), where lower is its probability after the
context less its first token, and that of the base score after none. So the
probabilities of all tokens and one unknown add up to 1 after any context whose
counts are EXACT at most; beyond, quantised counts may miss their sum by 6 %, and
a false yes of the filter (one in about 16,000 at a level) adds what it says.

Tokens are told apart by 64-bit hashes: of ten million, two collide with a
chance of three in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import low_words, mix64, partitions

#: The end token, and the mark before a text; no word holds a space.
END, START = b" ", b"  "
#: One document in HOLD_OUT is not trained on.
HOLD_OUT = 10
#: Bits of an entry (a level of an n-gram) and probes for it: one in 2 ** PROBES others is found by mistake.
BITS_PER_ENTRY, PROBES = 20, 14
#: Counts up to EXACT are levels of their own; from there on a doubling has FINE levels. The last level fits a byte.
EXACT, FINE, LEVELS = 16, 6, 255
#: Rows of the input for each segment, tokens that a task sums up at a time.
SEGMENT_ROWS, FLUSH_TOKENS = 1000, 2_000_000
#: Tokens that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 250_000
#: The copies that the shorter context counts as.
PULL = 1.0
U = np.uint64


class Hashes(dict):
    """Token to 64-bit hash, remembered."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def bigram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * U(0x9E3779B97F4A7C15) + b)


def cut(x: np.ndarray) -> np.ndarray:
    """The 48 bits by which n-grams are counted."""
    return x >> U(16)


def segment_of(h48: np.ndarray, segments: int) -> np.ndarray:
    return ((h48 >> U(16)) * U(segments)) >> U(32)


def pack_steps(x: np.ndarray) -> bytes:
    """Sorted integers as steps, byte by byte: the low bytes, which look random, as they are and the high ones compressed."""
    steps = np.diff(x, prepend=U(0)) if len(x) else x
    low = min(7, (int(x[-1] // U(len(x))).bit_length() - 1) // 8) if len(x) and x[-1] else 0
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return bytes([low]) + planes[:low].tobytes() + pa.compress(planes[low:].tobytes(), codec="zstd", asbytes=True)


def unpack_steps(b: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.uint64)
    low, high = b[0], pa.decompress(b[1 + b[0] * n :], decompressed_size=(8 - b[0]) * n, codec="zstd", asbytes=True)
    planes = np.frombuffer(b[1 : 1 + low * n] + high, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


def level(count: np.ndarray) -> np.ndarray:
    """The quantised count, from 1."""
    n = np.maximum(count, 1)
    return np.minimum(np.where(n <= EXACT, n, EXACT + np.rint(FINE * np.log2(n / EXACT)).astype(np.int64)), LEVELS)


def estimate(lv: np.ndarray) -> np.ndarray:
    """Counts as the filter has them: the middle of the level's stretch, 0 for none."""
    lv = lv.astype(np.float64)
    return np.where(lv <= EXACT, lv, EXACT * np.exp2((lv - EXACT) / FINE))


def hashed(h48: np.ndarray, level_: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves from which the places of an n-gram at a level are made."""
    x = mix64(h48 * U(2654435761) + U(level_ * 0x9E3779B97F4A7C15 % (1 << 64)))
    return x >> U(32), x & U(0xFFFFFFFF) | U(1)


def positions(halves: tuple[np.ndarray, np.ndarray], probe: int, bits: int) -> np.ndarray:
    return ((halves[0] + U(probe) * halves[1] & U(0xFFFFFFFF)) * U(bits)) >> U(32)


def probed(filter_: np.ndarray, h48: np.ndarray, bits: int) -> np.ndarray:
    """The level of each n-gram, 0 if none: probing goes on while the filter says yes."""
    out = np.zeros(len(h48), dtype=np.int64)
    alive = np.arange(len(h48))
    for lv in range(1, LEVELS + 1):
        a, b = hashed(h48[alive], lv)
        for probe in range(PROBES):
            pos = positions((a, b), probe, bits)
            yes = (filter_[pos >> U(3)] >> (pos & U(7)).astype(np.uint8)) & 1 == 1
            if not yes.all():
                alive, a, b = alive[yes], a[yes], b[yes]
        if not len(alive):
            break
        out[alive] = lv
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    held = (F.crc32(name.cast("binary")) % HOLD_OUT) == 0
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def pack_counts(n: np.ndarray) -> bytes:
    """Counts in one, four or eight bytes each, compressed, after their number and width."""
    most = int(n.max()) if len(n) else 0
    width = 1 if most < 256 else 4 if most < 1 << 32 else 8
    return len(n).to_bytes(8, "little") + bytes([width]) + pa.compress(n.astype(f"<u{width}").tobytes(), codec="zstd", asbytes=True)


def unpack_counts(b: bytes) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), b[8]
    return np.frombuffer(pa.decompress(b[9:], decompressed_size=n * width, codec="zstd", asbytes=True), dtype=f"<u{width}").astype(np.int64)


def marked(h: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stream of token hashes with two marks before each text, and where in it the tokens are."""
    real = np.arange(len(h)) + 2 * np.repeat(np.arange(1, len(lengths) + 1), lengths)
    x = np.full(len(h) + 2 * len(lengths), xxhash.xxh64_intdigest(START), dtype=np.uint64)
    x[real] = h
    return x, real


def grams(x: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams and the trigrams that end at each token, as 48 bits."""
    two = bigram(x[real - 1], x[real])
    return cut(two), cut(bigram(mix64(x[real - 2]), two))


def vocabulary(texts: DataFrame, segments: int) -> tuple[int, int]:
    """The training tokens, all and distinct."""
    gap = -(-(1 << 48) // segments)
    inner = np.arange(1, segments, dtype=np.uint64) * U(gap)
    low_ = np.r_[U(0), inner] << U(16)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        met: set[int] = set()
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            tokens = np.sort(np.fromiter(met, dtype=np.uint64, count=len(met)))
            edges = np.searchsorted(cut(tokens), inner)
            rows = [(s, pack_steps(tokens[a:b] - low_[s]), int(b - a), 0) for s, (a, b) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(tokens)])) if a < b]
            rows[0] = (*rows[0][:3], n)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["seg", "h", "size", "n"])

        for batch in _batches(batches):
            for text in batch.column(2).to_pylist():
                w = low_words(text)
                n += len(w) + 1
                met.update(map(known.__getitem__, w))
                met.add(known[END])
                if len(met) > REMEMBERED * 2:
                    yield from flush()
                    met, n = set(), 0
        if met:
            yield from flush()

    def reduce(key: tuple, t: pa.Table) -> pa.Table:
        parts = [unpack_steps(h, n) for h, n in zip(t.column("h").to_pylist(), t.column("size").to_pylist())]
        return pa.table([pa.array([sum(t.column("n").to_pylist())]), pa.array([len(np.unique(np.concatenate(parts)))])], names=["n", "v"])

    rows = texts.where("not held_out").mapInArrow(read, "seg long, h binary, size long, n long")
    sums = rows.groupBy("seg").applyInArrow(reduce, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return int(sums[0] or 0), int(sums[1] or 0)


def asked(texts: DataFrame, segments: int) -> DataFrame:
    """Runs of texts: a row of its own for each (seg < 0), and one for each segment that it asks.

    A run's row has its texts in a, its distinct token hashes in b, its tokens as
    places among those in c. A question has tokens and their training counts in a
    and b, n-grams and theirs in c and d.
    """
    gap = -(-(1 << 48) // segments)
    inner = np.arange(1, segments, dtype=np.uint64) * U(gap)
    low_ = np.r_[U(0), inner] << U(16)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        uid = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        names: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(w) for w in held])
            x, real = marked(np.concatenate(held), lengths)
            trains = np.repeat(np.array([not n[1] for n in names]), lengths)
            tokens, place = np.unique(x[real], return_inverse=True)
            n_tokens = np.bincount(place[trains], minlength=len(tokens))
            two = np.sort((np.concatenate(grams(x, real)) << U(1)) | np.r_[trains, trains].astype(np.uint64))
            at = np.flatnonzero(np.r_[True, two[1:] >> U(1) != two[:-1] >> U(1)])
            own, n_own = two[at] >> U(1), np.add.reduceat((two & U(1)).astype(np.int64), at)
            main = pa.table([pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.bool_()), pa.array(lengths)], names=list("dht"))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, main.schema) as w:
                w.write_table(main)
            rank = np.argsort(-np.bincount(place), kind="stable")  # frequent tokens get small numbers, which pack well
            number = np.empty(len(rank), dtype="<u4")
            number[rank] = np.arange(len(rank))
            planes = np.ascontiguousarray(number[place].view(np.uint8).reshape(-1, 4).T)
            rows = [(-1 - uid, uid, sink.getvalue().to_pybytes(), tokens[rank].tobytes(), pa.compress(planes.tobytes(), codec="zstd", asbytes=True), b"")]
            e, f = np.searchsorted(cut(tokens), inner), np.searchsorted(own, inner)
            for s, (a, b, c, d) in enumerate(zip(np.r_[0, e], np.r_[e, len(tokens)], np.r_[0, f], np.r_[f, len(own)])):
                if a < b or c < d:
                    rows.append((s, uid, pack_steps(tokens[a:b] - low_[s]), pack_counts(n_tokens[a:b]), pack_steps(own[c:d] - (low_[s] >> U(16))), pack_counts(n_own[c:d])))
            for low in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[low : low + 64]), ASKED_ARROW.types)], schema=ASKED_ARROW)

        for batch in _batches(batches):
            for name, out, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(known.of([*low_words(text), END]))
                names.append((name, out))
                size += len(held[-1])
                if size > FLUSH_TOKENS:
                    yield from flush()
                    held, names, size = [], [], 0
                    uid += 1
        if size:
            yield from flush()

    return texts.mapInArrow(read, ASKED_SCHEMA)


ASKED_SCHEMA = "seg long, uid long, a binary, b binary, c binary, d binary"
ASKED_ARROW = pa.schema([("seg", pa.int64()), ("uid", pa.int64()), *[(c, pa.binary()) for c in "abcd"]])


def added(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, sorted, their summed counts, and the place of each x among them."""
    values, place = np.unique(x, return_inverse=True)
    return values, np.bincount(place, n, minlength=len(values)).astype(np.int64), place


def filter_piece(own: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, int]:
    """The filter of a segment's n-grams that training texts hold, and its bits."""
    own, lv = own[count > 0], level(count[count > 0])
    bits = max(64, -(-int(lv.sum()) * BITS_PER_ENTRY // 64) * 64)
    set_ = np.zeros(bits, dtype=bool)
    for at in range(1, int(lv.max()) + 1 if len(lv) else 1):
        own, lv = own[lv >= at], lv[lv >= at]
        halves = hashed(own, at)
        for probe in range(PROBES):
            set_[positions(halves, probe, bits)] = True
    return np.packbits(set_, bitorder="little"), bits


def answered(rows: DataFrame, segments: int) -> DataFrame:
    """Runs as they are, and for each question the levels of its n-grams and its tokens' counts (a, b)."""
    gap = -(-(1 << 48) // segments)

    def reduce(key: tuple, t: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return t
        parts: list[tuple] = []
        for th, tc, gh, gc in zip(*(t.column(c).to_pylist() for c in "abcd")):
            m, n = unpack_counts(tc), unpack_counts(gc)
            parts.append((unpack_steps(th, len(m)), m, unpack_steps(gh, len(n)), n))  # less the segment's first, which tells none apart
        first = U(key[0].as_py()) * U(gap)
        _, tc, t_at = added(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
        own, gc, g_at = added(*(np.concatenate([p[i] for p in parts]) for i in (2, 3)))
        own += first
        piece, bits = filter_piece(own, gc)
        g_level = probed(piece, own, bits)
        out: list[tuple] = []
        i = j = 0
        for uid, (h, _, g, _) in zip(t.column("uid").to_pylist(), parts):
            a, b = t_at[i : i + len(h)], g_at[j : j + len(g)]
            out.append((key[0].as_py(), uid, pack_counts(g_level[b]), pack_counts(tc[a]), b"", b""))
            i, j = i + len(h), j + len(g)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), ASKED_ARROW.types)], schema=ASKED_ARROW)

    spread = max(partitions(rows.sparkSession), segments // 8)
    return rows.repartition(spread, "seg").groupBy("seg").applyInArrow(reduce, ASKED_SCHEMA)


def log_probabilities(real: np.ndarray, c: np.ndarray, c2: np.ndarray, c3: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 p of the tokens at `real` in the marked stream.

    `c` are the stream's counts as contexts, with that of texts for a mark; c2 and
    c3 are those of the n-grams that end at the tokens. A trigram counts only if
    its bigram does, and none more often than its context.
    """
    base = (c[real] + 0.1) / (n + 0.1 * (v + 1))
    c1 = c[real - 1]
    c2 = np.minimum(c2, c1)
    before = np.r_[0.0, c2[:-1]] * np.r_[False, np.diff(real) == 1]
    c3 = np.where(c2 > 0, np.minimum(c3, before), 0.0)
    p2 = np.where(c1 > 0, (c2 + PULL * base) / (c1 + PULL), base)
    return np.log10(np.where(before > 0, (c3 + PULL * p2) / (before + PULL), p2))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    All tokens, bigrams and trigrams of the training texts are in the model, at any
    size of the table. A null or empty text is the end token alone. A null id
    counts as the empty string and so as held out. Repeated rows are trained on
    and scored each time. A text longer than a run is a run of its own. Other
    columns are not read. Without training rows all counts are 0 and `score` and
    `base_score` take a vocabulary of none. An empty table gives no rows.
    """
    spark = docs.sparkSession
    segments = max(16, min(1 << 16, -(-docs.count() // SEGMENT_ROWS)))
    texts = _texts(docs, id_col, text_col)
    n, v = vocabulary(texts, segments)
    floor = float(np.log10(n + 0.1 * (v + 1)))
    end = xxhash.xxh64_intdigest(END)

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("seg", "a", "b", "c"))), key=lambda r: r[0])
        main = pa.ipc.open_stream(rows[0][1]).read_all()
        lengths = main.column("t").to_numpy()
        numbered = np.frombuffer(rows[0][2], dtype="<u8")
        size = int(lengths.sum())
        planes = np.frombuffer(pa.decompress(rows[0][3], decompressed_size=4 * size, codec="zstd", asbytes=True), dtype=np.uint8)
        ids = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
        order = np.argsort(numbered)
        count = np.zeros(len(order), dtype=np.int64)
        count[order] = np.concatenate([unpack_counts(r[2]) for r in rows[1:]])
        g_level = np.concatenate([unpack_counts(r[1]) for r in rows[1:]])
        x, real = marked(numbered[ids], lengths)
        values, place = np.unique(np.concatenate(grams(x, real)), return_inverse=True)
        if len(values) != len(g_level):
            raise RuntimeError(f"{len(g_level)} answers for {len(values)} n-grams")
        c2, c3 = np.split(estimate(g_level)[place], 2)
        c = np.full(len(x), float(count[numbered == U(end)][0]))  # every text has one end, so a mark counts as often
        c[real] = count[ids]
        at = np.repeat(np.arange(len(lengths)), lengths)
        total = np.bincount(at, log_probabilities(real, c, c2, c3, n, v))
        base, seen = np.bincount(at, np.log10(count + 0.1)[ids]), np.bincount(at, (count > 0)[ids]).astype(np.int64)
        return pa.table([main.column("d"), main.column("h"), main.column("t"), pa.array(seen), pa.array(np.full(len(lengths), n)), pa.array(base - lengths * floor), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    spread = max(partitions(spark), segments // 8)
    both = answered(asked(texts, segments), segments).drop("d").repartition(spread, "uid").groupBy("uid")
    return both.applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
