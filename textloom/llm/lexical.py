"""Ranked lexical search: the best documents of every item by exact integer scores, as a threshold-seeded join.

Only postings of terms that an item asks for are kept. Each term stores its k
greatest impacts and their rows: an item's kth score is no less than any of its
terms' kth impact, nor than the kth exact score of the rows so stored. Below
that floor, terms whose greatest impacts add up to less are pruned: a row
that has none of the others can't reach it. The other terms' postings make the
candidates, of which those go whose sum and what the pruned terms can add at
most stay below the floor, which the kth of these sums raises once more. What
is left is scored exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import store

#: Documents of an item, keys over which the lines that tell lengths are spread, and the part of a floor under which terms are left to the exact score.
TOP, SPREAD, UNREAD = 10, 1024, 4
# Fixed values of the score: its scale, its saturation, and the parts of 100 that follow a document's length.
SCALE, SATURATION, LENGTH_PART = 1_000_000_000, 8, 75

#: Bytes of terms, A-Z in lower case, all others a space.
TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TERMS).split(b" ") if text else []


def term_counts(rows: DataFrame) -> DataFrame:
    """(row, id, n, term, tf) of rows (row, id, text); one line with a null term tells a text's number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        names = ["row", "id", "n", "term", "tf"]
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for row, own, text in zip(*[batch.column(i) for i in range(3)]):
                found = Counter(terms_of(text.as_py()))
                found.pop(b"", None)
                n = found.total()
                for column, values in zip(out, ([row.as_py()] * (len(found) + 1), [own.as_py()] * (len(found) + 1), [n] * (len(found) + 1), [None, *found], [n, *found.values()])):
                    column += values
                if len(out[0]) >= 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == pa.string() else k).cast(k) for c, k in zip(out, kinds)], names=names)
                    out = ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == pa.string() else k).cast(k) for c, k in zip(out, kinds)], names=names)

    return rows.mapInArrow(run, "row long, id long, n long, term string, tf long")


def _packed(found: DataFrame) -> DataFrame:
    """(row, id, n, ts, tfs): neighbouring lines of one row as one; a row may still have several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(1).to_numpy()
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, dtype=np.int64)
            edges = pa.array(np.concatenate([start, [len(row)]]).astype(np.int32))
            one = [batch.column(i).take(pa.array(start)) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*one, *[pa.ListArray.from_arrays(edges, batch.column(i)) for i in (0, 4)]], names=["row", "id", "n", "ts", "tfs"])

    return found.select("t", "row", "id", "n", "tf").mapInArrow(run, "row long, id long, n long, ts array<long>, tfs array<long>")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `k` best documents with a score above 0.

    Equal scores go by ascending id, a null id last, then by row. Null and empty
    texts have no terms: as documents they are never found, as items they find
    nothing. Repeated rows are found each, repeated items (or ids) have a ranking
    each, also under a null id. Other columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    numbered = lambda df, own: df.select(F.monotonically_increasing_id().alias("row"), F.col(own).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    wanted = store(term_counts(numbered(items, item_id)).where("term is not null").select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term", F.col("tf").alias("times")), "items")
    asked = store(wanted.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "asked")

    # Postings of the asked terms, and of each text under number -1 the line that tells its length; those lines are spread over keys that no term has.
    spread = lambda c: F.concat(F.lit(" "), F.pmod(F.col(c), F.lit(SPREAD)).cast("string"))
    marked = asked.select(F.col("term").alias("asked"), "t").unionByName(spark.range(SPREAD).select(spread("id").alias("asked"), F.lit(-1).cast("long").alias("t")))
    counted = term_counts(numbered(docs, doc_id))
    postings = store(_packed(counted.join(marked, F.coalesce("term", spread("row")) == F.col("asked"))), "postings")
    lines = postings.select("row", "id", "n", F.inline(F.arrays_zip("ts", "tfs"))).withColumnsRenamed({"ts": "t", "tfs": "tf"})

    texts = lines.where("t = -1 and n > 0").agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L"))
    total = texts.first()  # two numbers
    n_texts, n_terms = F.lit(total.N).cast("long"), F.lit(max(1, total.L)).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    m = 100 - LENGTH_PART + div(LENGTH_PART * F.col("n") * n_texts, n_terms)
    impact = div(SCALE * F.col("tf"), 1000 * F.col("tf") + SATURATION * m)
    hits = lines.where("t >= 0").select("t", "row", "id", impact.alias("g"))

    # What the index stores of a term: its weight, its greatest and its kth impact, and the rows of the k greatest.
    frequency = hits.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.max("g").alias("most"))
    first = hits.withColumn("place", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("g"), "row"))).where(F.col("place") <= k)
    first = store(first.select("t", "row", "g", "place"), "first")
    kth = first.where(F.col("place") == k).select("t", F.col("g").alias("kth"))
    weight = F.floor(1000 * F.log((2 * n_texts + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = frequency.select("t", weight.alias("w"), "most").where("w > 0")
    terms = wanted.join(asked, "term").join(weights, "t").join(kth, "t", "left")
    times = F.col("w") * F.col("times")
    terms = store(terms.select("item", "item_id", "t", times.alias("w"), (times * F.col("most")).alias("most"), (times * F.coalesce("kth", F.lit(0))).alias("kth")), "terms")

    # Seeds: the stored rows of an item's terms, scored exactly; their kth score is a floor of the item's.
    seeds = terms.select("item", "t").join(first.select("t", "row"), "t").select("item", "row").distinct()
    place = Window.partitionBy("item").orderBy(F.desc("score"), "row")
    seeded = _score(postings, impact, terms, seeds).withColumn("place", F.row_number().over(place)).where(F.col("place") == k).select("item", F.col("score").alias("seeded"))
    floors = terms.groupBy("item").agg(F.max("kth").alias("kth")).join(seeded, "item", "left").select("item", F.greatest("kth", F.coalesce("seeded", F.lit(0))).alias("floor"))

    # Terms from the least of their greatest impacts on: `rest` is what a term and all before it can add at most. Where it is
    # under the floor the term makes no candidates, and where it is under a part of the floor its postings are not even read.
    one = Window.partitionBy("item")
    suffix = one.orderBy("most", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = F.col("rest") * UNREAD < F.col("floor")
    bounded = terms.join(floors, "item").withColumn("rest", F.sum("most").over(suffix)).withColumn("spare", F.coalesce(F.max(F.when(low, F.col("rest"))).over(one), F.lit(0)))
    bounded = store(bounded.where(~low).select("item", "t", "w", "floor", "spare", (F.col("rest") >= F.col("floor")).alias("makes")), "bounded")
    sums = hits.join(bounded, "t").groupBy("item", "row").agg(F.sum(F.col("w") * F.col("g")).alias("sum"), F.bool_or("makes").alias("makes"), F.first("floor").alias("floor"), F.first("spare").alias("spare"))
    part = store(sums.where(F.col("makes") & (F.col("sum") + F.col("spare") >= F.col("floor"))).select("item", "row", "sum", "spare"), "part")

    # No score is under its part, so the kth part is a floor too.
    least = part.withColumn("place", F.row_number().over(one.orderBy(F.desc("sum"), "row"))).where(F.col("place") == k).select("item", F.col("sum").alias("least"))
    candidates = part.join(least, "item", "left").where(F.col("sum") + F.col("spare") >= F.coalesce("least", F.lit(0))).select("item", "row")
    candidates = store(candidates, "candidates")

    best = _score(postings, impact, terms, candidates).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    ids = wanted.select("item", "item_id").distinct()
    return ranked.join(ids, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _score(postings: DataFrame, impact: Column, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(item, row, id, score): the exact scores of pairs of item and row."""
    met = pairs.join(postings, "row").select("item", "row", "id", "n", F.inline(F.arrays_zip("ts", "tfs"))).withColumnsRenamed({"ts": "t", "tfs": "tf"})
    parts = met.join(terms.select("item", "t", "w"), ["item", "t"]).select("item", "row", "id", (F.col("w") * impact).alias("part"))
    return parts.groupBy("item", "row").agg(F.first("id").alias("id"), F.sum("part").alias("score"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id,
             unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT i, item_id, term, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT count(*) AS n, sum(len(terms)) AS l FROM d WHERE len(terms) > 0),
p AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p SEMI JOIN a USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, s.n),
g AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * tf.n * s.n) // s.l)) AS g FROM tf, s),
x AS (SELECT a.i, a.item_id, g.r, g.doc_id, sum(a.times * w.w * g.g)::BIGINT AS score FROM a JOIN w USING (term) JOIN g USING (term) GROUP BY ALL HAVING sum(a.times * w.w * g.g) > 0),
y AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank FROM x)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 10
"""
