"""Queries of pairs, search, vectors, clusters, topics, mentions and change points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import kana, text
from textloom.functions.numbers import rounded
from textloom.operators import changepoint, clusters, mentions, metrics, pairs, search, topics, vectors, ward
from textloom.operators.ranking import running_total, scratch, shared_path
from textloom.plans.registry import query, sql_values, table, values
from textloom.sources import bundle, sinks

GRAM = 8
TERMS = "[a-z]{3,}"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _words() -> Column:
    return F.regexp_extract_all(F.lower("text"), F.lit(TERMS), F.lit(0))


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_frequencies(_docs(spark, sf_dir), "doc_id", _words())


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, dl): what `search.doc_lengths` counts in postings, from the texts themselves."""
    return _docs(spark, sf_dir).groupBy(F.col("doc_id").alias("doc")).agg(F.sum(F.greatest(F.coalesce(F.size(_words()), F.lit(0)), F.lit(0))).alias("dl"))


_TF = "(SELECT doc_id AS doc, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) GROUP BY ALL)"

# --- pairs of works -----------------------------------------------------------------------

_CLASSES = "classes AS (SELECT min(doc_id) AS a, count(*) AS members, frame FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS frame FROM documents) WHERE frame <> '' GROUP BY frame), g AS (SELECT DISTINCT a, length(frame) AS len, substr(frame, i, 8) AS g FROM classes, range(1, greatest(length(frame) - 6, 1)) AS r(i)), n AS (SELECT a, len, count(*) AS n FROM g GROUP BY ALL)"
_SCORED = "s AS (SELECT x.a AS a, y.a AS b, count(*) AS s FROM g x JOIN g y ON x.g = y.g AND x.a < y.a GROUP BY ALL), j AS (SELECT s.a, s.b, s.s / (p.n + q.n - s.s) AS score, q.len / p.len AS ratio FROM s JOIN n p ON p.a = s.a JOIN n q ON q.a = s.b)"


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.classes(_docs(spark, sf_dir), "doc_id", F.lower("text"), GRAM, "a-z")


@query("jon_near_pairs", f"WITH {_CLASSES}, {_SCORED} SELECT a, b, round(score, 4) AS score FROM j WHERE score >= 0.5 AND ratio > 0.6 AND ratio < 1.7")
def jon_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs between classes of equal frames; members of a class are in jon_pair_classes."""
    return pairs.find_pairs(_classes(spark, sf_dir)).select("a", "b", rounded("score", 4).alias("score"))


@query("jon_pair_classes", f"WITH {_CLASSES} SELECT a, CAST(members AS BIGINT) AS members FROM classes WHERE members > 1")
def jon_pair_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir).where("members > 1").select("a", "members")


@query(
    "jon_gap_report",
    f"WITH {_CLASSES}, {_SCORED}, c AS (SELECT count(*) AS compared FROM (SELECT a, length(frame) AS len FROM classes) x JOIN (SELECT a, length(frame) AS len FROM classes) y ON x.a < y.a AND y.len / x.len > 0.6 AND y.len / x.len < 1.7) SELECT round(min(CASE WHEN score >= 0.5 THEN score END), 6) AS matched_min, round(greatest(coalesce(max(CASE WHEN score < 0.5 THEN score END), 0), 0), 6) AS unmatched_max, CAST(count(*) FILTER (score >= 0.5) AS BIGINT) AS matched, CAST(any_value(compared) AS BIGINT) AS compared FROM j, c WHERE ratio > 0.6 AND ratio < 1.7",
)
def jon_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pairs.gap_report(_classes(spark, sf_dir))
    return r.select(rounded("matched_min", 6).alias("matched_min"), rounded("unmatched_max", 6).alias("unmatched_max"), "matched", "compared")


_PAIRS = f"WITH {_CLASSES}, {_SCORED}, p AS (SELECT a, b FROM j WHERE score >= 0.5 AND ratio > 0.6 AND ratio < 1.7), t AS (SELECT p.a, p.b, x.lang AS ka, y.lang AS kb, x.n_chars AS ca, y.n_chars AS cb, x.source = y.source AS same_title FROM p JOIN documents x ON x.doc_id = p.a JOIN documents y ON y.doc_id = p.b)"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.classify(pairs.find_pairs(_classes(spark, sf_dir)), _docs(spark, sf_dir), "doc_id", "lang", "source")


@query("jon_pair_types", f"{_PAIRS} SELECT a, b, CASE WHEN ka <> kb THEN 'variant' ELSE 'duplicate' END AS pair_type, same_title FROM t")
def jon_pair_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark, sf_dir).select("a", "b", "pair_type", "same_title")


@query("ded_drop_side", f"{_PAIRS} SELECT CASE WHEN first THEN a ELSE b END AS \"drop\", CASE WHEN first THEN b ELSE a END AS keep FROM (SELECT a, b, CASE WHEN ka <> kb THEN ka = 'fr' ELSE ca < cb END AS first FROM t)")
def ded_drop_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.drop_side(_typed(spark, sf_dir), _docs(spark, sf_dir), "doc_id", "n_chars", "fr").select("drop", "keep")


@query("jon_pair_both_ways", f"{_PAIRS} SELECT doc_id, other FROM documents JOIN (SELECT a AS doc_id, b AS other FROM p UNION ALL SELECT b, a FROM p) USING (doc_id)")
def jon_pair_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs.find_pairs(_classes(spark, sf_dir)).select("a", "b")
    both = p.select(F.col("a").alias("doc_id"), F.col("b").alias("other")).union(p.select("b", "a"))
    return _docs(spark, sf_dir).select("doc_id").join(both, "doc_id")


@query(
    "jon_align_passages",
    "WITH d AS (SELECT doc_id, text, doc_id % 2 AS side, doc_id // 40 AS pair FROM documents WHERE length(text) >= 4), g AS (SELECT DISTINCT doc_id, side, pair, substr(text, i, 4) AS g FROM d, range(1, length(text) - 2) AS r(i)), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), s AS (SELECT x.doc_id AS q, y.doc_id AS gold, count(*) AS s FROM g x JOIN g y ON x.pair = y.pair AND x.g = y.g AND x.side = 0 AND y.side = 1 GROUP BY ALL), j AS (SELECT q, gold, s / (a.n + b.n - s) AS score FROM s JOIN n a ON a.doc_id = q JOIN n b ON b.doc_id = gold) SELECT q, gold, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, gold) AS r FROM j) WHERE r = 1 AND score >= 0.35",
)
def jon_align_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even documents against odd ones of the same forty."""
    d = _docs(spark, sf_dir).where("length(text) >= 4").select("doc_id", F.floor(F.col("doc_id") / 40).alias("pair"), "text")
    old, new = d.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "q"), d.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "gold")
    return pairs.align(old, new).withColumn("score", rounded("score", 4))


@query("agg_fold_calibration")
def agg_fold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of old and new spellings after each stage of the fold: median, least, and how many reach 0.99."""
    rows = values(spark, [("思ふに、さうしてしまふ", "思うに、そうしてしまう"), ("私は海をだきしめてゐたい", "私は海をだきしめていたい"), ("きやう、ちよつと行つた", "きょう、ちょっと行った")], "old string, new string")

    def ratio(a, b):
        import difflib

        return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()

    like = F.udf(ratio, "double", useArrow=True)
    old, new = kana.fold_stages(F.col("old")), kana.fold_stages(F.col("new"))
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), old[k].alias("a"), new[k].alias("b")) for k in old])).alias("s")).select("s.stage", like("s.a", "s.b").alias("r"))
    return each.groupBy("stage").agg(F.round(F.median("r"), 4).alias("median"), F.round(F.min("r"), 4).alias("min"), F.count_if(F.col("r") >= 0.99).alias("ge_099"))


# --- BM25 ---------------------------------------------------------------------------------


@query("agg_term_frequencies", f"SELECT doc, term, tf FROM {_TF}")
def agg_term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tf(spark, sf_dir)


@query("agg_inverted_index", f"SELECT term, CAST(nth // 4096 AS BIGINT) AS block, any_value(df) AS df, string_agg(doc || ':' || tf, ' ' ORDER BY doc) AS postings FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc) - 1 AS nth, CAST(count(*) OVER (PARTITION BY term) AS BIGINT) AS df FROM {_TF}) GROUP BY ALL")
def agg_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = search.postings(_tf(spark, sf_dir))
    return p.select("term", "block", "df", F.array_join(F.transform("postings", lambda s: F.concat_ws(":", s["doc"].cast("string"), s["tf"].cast("string"))), " ").alias("postings"))


@query("win_posting_gaps", f"SELECT term, doc, doc - lag(doc, 1, 0) OVER (PARTITION BY term ORDER BY doc) AS gap FROM {_TF}")
def win_posting_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.gaps(_tf(spark, sf_dir))


@query("agg_doc_lengths", f"SELECT d.doc_id AS doc, CAST(coalesce(sum(tf), 0) AS BIGINT) AS dl FROM documents d LEFT JOIN {_TF} t ON t.doc = d.doc_id GROUP BY 1")
def agg_doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.doc_lengths(_tf(spark, sf_dir), _docs(spark, sf_dir), "doc_id")


@query("snk_postings_round_trip", f"SELECT term, doc, least(tf, 65535) AS tf FROM {_TF}")
def snk_postings_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting lists through their varint bytes and back."""
    return sinks.decode_postings(sinks.encode_postings(search.postings(_tf(spark, sf_dir))))


@query("snk_index_file", f"SELECT term, doc, least(tf, 65535) AS tf, least(dl, 65535) AS dl FROM {_TF} JOIN (SELECT doc, sum(tf) AS dl FROM {_TF} GROUP BY 1) USING (doc)")
def snk_index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings and lengths out into the single files of a search index, and back from their bytes."""
    path, docs = shared_path(spark, "index"), bundle.numbered(_lengths(spark, sf_dir))
    named = _docs(spark, sf_dir).select("doc_id", "text").join(docs.select("doc", "no"), F.col("doc_id") == F.col("doc"))
    bundle.write_numbered(search.term_frequencies(named, "no", _words()), docs, path)
    return bundle.read_index(spark, path, lengths=True)


@query("snk_vector_file", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS no, vec_id, TRUE AS near FROM embeddings")
def snk_vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors out into one half-precision file with parallel arrays, and back: each is near what it was."""
    e, path = table(spark, sf_dir, "embeddings"), shared_path(spark, "vectors")
    bundle.write_vectors(e.select(F.col("vec_id").alias("i"), F.col("label").alias("work"), F.col("embedding").alias("v")), path, 64)
    back = bundle.read_vectors(spark, path).join(bundle.read_vector_index(spark, path), "no")
    worst = F.array_max(F.zip_with("embedding", "v", lambda a, b: F.abs(a - b)))
    return back.join(e, F.col("id") == F.col("vec_id")).select("no", "vec_id", (worst < 0.001).alias("near"))


_VAR = [0, 1, 127, 128, 300, 16384, 4294967295]


@query("snk_varint", f"SELECT * FROM {sql_values([(n, h) for n, h in zip(_VAR, ['00', '01', '7F', '8001', 'AC02', '808001', 'FFFFFFFF0F'])], 'n, hex')}")
def snk_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, [(n,) for n in _VAR], "n long").select("n", F.hex(sinks.varints(F.array("n"))).alias("hex"))


@query("snk_offsets", f"SELECT term, CAST(coalesce(sum(df) OVER (ORDER BY term ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT term, count(*) AS df FROM {_TF} GROUP BY 1)")
def snk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term's place in the file of all postings, in entries; sinks.with_offsets gives it in bytes."""
    df = search.document_frequencies(_tf(spark, sf_dir))
    return running_total(df, [F.col("term")], F.col("df"), "before").select("term", "before")


_SCORE = f"tf AS {_TF}, l AS (SELECT d.doc_id AS doc, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN tf ON tf.doc = d.doc_id GROUP BY 1), st AS (SELECT count(*) AS n, round(avg(dl), 3) AS avgdl FROM l), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), q AS (SELECT item_id AS q, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS term FROM benchmark) GROUP BY ALL), sc AS (SELECT q.q, tf.doc, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * CASE WHEN dl = 0 THEN 1 ELSE dl END / avgdl))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN l ON l.doc = tf.doc, st GROUP BY ALL)".replace("{{", "{").replace("}}", "}")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERMS), F.lit(0))).alias("term"))
    return search.score(_tf(spark, sf_dir), _lengths(spark, sf_dir), q).withColumn("score", F.round("score", 6))


@query("vec_bm25_top", f"WITH {_SCORE} SELECT q, doc, CAST(r AS INT) AS rank, round(score, 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS r FROM sc) WHERE r <= 10")
def vec_bm25_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(_scores(spark, sf_dir), 10).select("q", "doc", "rank", F.round("score", 3).alias("score"))


@query("win_bm25_diversified", f"WITH {_SCORE}, w AS (SELECT sc.*, source, row_number() OVER (PARTITION BY q, source ORDER BY score DESC, doc) AS nth FROM sc JOIN documents ON doc_id = doc) SELECT q, doc, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS r FROM w WHERE nth <= 2) WHERE r <= 12")
def win_bm25_diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = _docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("source").alias("work"))
    return search.diversify(_scores(spark, sf_dir), works).select("q", "doc", "rank")


@query("flt_active_passages", "SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 3)")
def flt_active_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.join(d.where("doc_id < 3").select("source"), "source", "left_anti").select("doc_id")


_CUT = [("青い海と空", "青い|海|空"), ("海空海", "海空|海"), ("なし", "")]


@query("txt_longest_match", f"SELECT * FROM {sql_values(_CUT, 'q, terms')}")
def txt_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = F.array(*map(F.lit, ("青い", "青", "海", "空", "海空")))
    rows = values(spark, [(q,) for q, _ in _CUT], "q string")
    return rows.select("q", F.array_join(search.longest_match(F.col("q"), vocabulary), "|").alias("terms"))


# --- vectors ------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"
_SIMS = f"(SELECT a.vec_id AS q, b.vec_id AS doc, b.label AS work, a.label AS own, round({_DOT}, 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"


_ALL_SIMS = _SIMS.replace(" WHERE a.vec_id % 20 = 0", "")


def _near(spark: SparkSession, sf_dir: str, k: int, exclude: str | None = None, digits: int = 9) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return search.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", k, exclude, digits)


def _near_all(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Every row's k nearest."""
    e = table(spark, sf_dir, "embeddings")
    return search.nearest(e, e, "vec_id", "embedding", k)


@query("jon_nearest", f"SELECT q, doc, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS r FROM {_SIMS}) WHERE r <= 10")
def jon_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 10).select("q", "doc", "rank")


_DIVERSE = f"SELECT q, doc, CAST(r AS INT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS r FROM (SELECT *, row_number() OVER (PARTITION BY q, work ORDER BY score DESC, doc) AS nth FROM {_SIMS}) WHERE nth <= 2) WHERE r <= 12"


@query("vec_passage_search", _DIVERSE)
def vec_passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: passages like a passage, at most two of a work."""
    e = table(spark, sf_dir, "embeddings")
    return search.passage_search(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", "label").select("q", "doc", "rank", F.round("score", 6).alias("score"))


@query("jon_other_works", f"SELECT q, doc, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS r FROM {_SIMS} WHERE work <> own) WHERE r <= 6")
def jon_other_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 6, "label").select("q", "doc", "rank")


@query("win_diversify", f"SELECT q, doc, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS r FROM (SELECT *, row_number() OVER (PARTITION BY q, work ORDER BY score DESC, doc) AS nth FROM {_SIMS} WHERE work <> 3) WHERE nth <= 2) WHERE r <= 12")
def win_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a skipped work."""
    e = table(spark, sf_dir, "embeddings")
    skipped = values(spark, [(3,)], "label int")
    return search.passage_search(e.join(skipped, "label", "left_anti"), e.where("vec_id % 20 = 0"), "vec_id", "embedding", "label").select("q", "doc", "rank")


@query("vec_unit", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS n2, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS scale FROM embeddings")
def vec_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.pow(vectors.norm(F.col("embedding")), 2), 6).alias("n2"), F.round(vectors.row_scale(F.col("embedding")), 6).alias("scale"))


@query("vec_quantize", "SELECT vec_id, i AS i, CAST(round_even(CAST(embedding[i] AS DOUBLE) / s * 127, 0) AS INT) AS code FROM (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS s FROM embeddings), range(1, 65) AS r(i)")
def vec_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("s", vectors.row_scale(F.col("embedding")))
    return e.select("vec_id", F.posexplode(vectors.quantize(F.col("embedding"), F.col("s"))).alias("i", "code")).withColumn("i", (F.col("i") + 1).cast("long"))


@query("snk_f16_round_trip", "SELECT vec_id, TRUE AS near FROM embeddings")
def snk_f16_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    back = vectors.from_f16(vectors.to_f16(F.col("embedding")))
    worst = F.array_max(F.zip_with("embedding", back, lambda a, b: F.abs(a - b)))
    return e.select("vec_id", (worst < 0.001).alias("near"))


@query("vec_projection")
def vec_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in the first 32 directions of the uncentred decomposition, of unit length."""
    e = table(spark, sf_dir, "embeddings")
    mean, basis, _ = vectors.components(e, "embedding", 32)
    return e.select("vec_id", vectors.project(F.col("embedding"), mean, basis).alias("z"))


@query("vec_lossless", f"SELECT q, doc, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 6) DESC, doc) AS r FROM {_SIMS}) WHERE r <= 10")
def vec_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With all directions kept and no centring, neighbours are what they were."""
    e = table(spark, sf_dir, "embeddings")
    mean, basis, _ = vectors.components(e, "embedding", 64)
    z = e.select("vec_id", vectors.project(F.col("embedding"), mean, basis, unit=False).alias("z"))
    return search.nearest(z, z.where("vec_id % 20 = 0"), "vec_id", "z", 10, digits=6).select("q", "doc", "rank")


@query("agg_compression_loss")
def agg_compression_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 8-bit and half-precision codes of 32 and 64 dimensions keep of the neighbours."""
    e = table(spark, sf_dir, "embeddings")
    base = scratch(_near(spark, sf_dir, 50), "base")
    out = None
    for dims in (32, 64):
        mean, basis, _ = vectors.components(e, "embedding", dims)
        z = e.select("vec_id", vectors.project(F.col("embedding"), mean, basis).alias("v"))
        z = z.withColumn("h", vectors.from_f16(vectors.to_f16(F.col("v")))).withColumn("s", vectors.row_scale(F.col("v")))
        z = z.withColumn("codes", vectors.quantize(F.col("v"), F.col("s"))).withColumn("back", F.transform("codes", lambda q: q.cast("double")))
        for name, v in (("float16", vectors.unit(F.col("h"))), ("int8_row", vectors.unit(F.col("back")))):
            coded = scratch(z.select("vec_id", v.alias("v")), "coded")
            other = scratch(search.nearest(coded, coded.where("vec_id % 20 = 0"), "vec_id", "v", 50), "other")
            row = vectors.loss(base, other).select(F.lit(dims).alias("dims"), F.lit(name).alias("dtype"), F.lit(dims * (2 if name == "float16" else 1)).alias("bytes"), *[F.round(c, 4).alias(c) for c in ("recall10", "top1", "tau")])
            out = row if out is None else out.unionByName(row)
    return out


@query("agg_kendall_tau", f"WITH b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS ra, row_number() OVER (PARTITION BY q ORDER BY round(score, 1) DESC, doc) AS rb FROM {_SIMS}), k AS (SELECT q, doc, ra, rb FROM b WHERE ra <= 20 AND rb <= 20) SELECT q, round(coalesce(tau, 0), 6) AS tau FROM (SELECT DISTINCT q FROM b WHERE ra <= 20) LEFT JOIN (SELECT x.q, sum(sign(y.rb - x.rb)) / sum(abs(sign(y.rb - x.rb))) AS tau FROM k x JOIN k y ON x.q = y.q AND x.ra < y.ra GROUP BY 1) USING (q)")
def agg_kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.kendall(_near(spark, sf_dir, 20), _near(spark, sf_dir, 20, digits=1)).withColumn("tau", F.round("tau", 6))


@query(
    "snk_parallel_arrays",
    "WITH p AS (SELECT *, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 65536 AS BIGINT) AS block FROM embeddings), w AS (SELECT label, min(block) AS block, row_number() OVER (ORDER BY min(vec_id)) - 1 AS w FROM p GROUP BY 1), n AS (SELECT block, string_agg(label, ',' ORDER BY w) AS works FROM w GROUP BY 1) SELECT p.block, coalesce(any_value(works), '') AS works, string_agg(w.w, ',' ORDER BY vec_id) AS w, string_agg(vec_id % 9, ',' ORDER BY vec_id) AS p FROM p JOIN w ON w.label = p.label LEFT JOIN n ON n.block = p.block GROUP BY 1",
)
def snk_parallel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 9).alias("p"))
    row = sinks.parallel_arrays(e, "label", "vec_id", ("p",))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return row.select("block", join("works"), join("w"), join("p"))


# --- clusters -----------------------------------------------------------------------------

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg_standardize", "WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in ("s_acctbal", "s_nationkey")) + " FROM supplier) SELECT s_suppkey, round((s_acctbal - m_s_acctbal) / CASE WHEN d_s_acctbal = 0 THEN 1 ELSE d_s_acctbal END, 6) AS s_acctbal, round((s_nationkey - m_s_nationkey) / CASE WHEN d_s_nationkey = 0 THEN 1 ELSE d_s_nationkey END, 6) AS s_nationkey FROM supplier, s")
def agg_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = clusters.standardize(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), ["s_acctbal", "s_nationkey"])
    return z.select("s_suppkey", F.round("s_acctbal", 6).alias("s_acctbal"), F.round("s_nationkey", 6).alias("s_nationkey"))


@query("vec_feature_matrix", "SELECT doc_id, list_sum([CAST(n_chars % 7 AS DOUBLE), 0.0]) AS total FROM documents")
def vec_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of features as arrays: what is missing is 0, sizes are left out."""
    m = F.create_map(F.lit("x"), (F.col("n_chars") % 7).cast("double"), F.lit("n_chars"), F.col("n_chars").cast("double"))
    rows = clusters.matrix(_docs(spark, sf_dir).select("doc_id", m.alias("f")), "doc_id", "f", ["x", "y", "n_chars", "n_chunks"])
    return rows.select(F.col("id").alias("doc_id"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


_D2 = "list_sum(list_transform(range(1, 65), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE)) * (CAST(e.embedding[i] AS DOUBLE) - CAST(c.embedding[i] AS DOUBLE))))"


@query("vec_kmeans_step", f"SELECT vec_id, CAST(label AS INT) AS label FROM (SELECT e.vec_id, c.vec_id AS label, row_number() OVER (PARTITION BY e.vec_id ORDER BY round({_D2}, 9), c.vec_id) AS r FROM embeddings e, embeddings c WHERE c.vec_id < 8) WHERE r = 1")
def vec_kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment step: the first eight vectors as centers."""
    e = table(spark, sf_dir, "embeddings")
    c = e.where("vec_id < 8").select(F.col("vec_id").cast("int").alias("label"), F.col("embedding").alias("c"))
    return clusters.assign(e.drop("label"), c, "vec_id", "embedding").select(F.col("id").alias("vec_id"), "label")


@query("vec_kmeans")
def vec_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.kmeans(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


@query("vec_ward")
def vec_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward clusters of all vectors, from one exact tree over all rows."""
    return ward.ward(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4)


@query("agg_adjusted_rand", "WITH c AS (SELECT lang AS a, quality AS b, CAST(count(*) AS DOUBLE) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS sij, sum(n) AS t FROM c), i AS (SELECT sum(n * (n - 1) / 2) AS si FROM (SELECT sum(n) AS n FROM c GROUP BY a)), j AS (SELECT sum(n * (n - 1) / 2) AS sj FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((sij - si * sj / (t * (t - 1) / 2)) / ((si + sj) / 2 - si * sj / (t * (t - 1) / 2)), 9) AS ari FROM s, i, j")
def agg_adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return clusters.adjusted_rand(rows, "lang", "quality").select(F.round("ari", 9).alias("ari"))


@query("win_partner_rank", f"SELECT q, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS r FROM {_SIMS}) WHERE doc = q + 1")
def win_partner_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of each query's partner, the next vector, among all its neighbours."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0")
    partner = asked.select(F.col("vec_id").alias("q"), (F.col("vec_id") + 1).alias("doc"))
    return search.ranks(e, asked, partner, "vec_id", "embedding").select("q", F.col("rank").cast("int").alias("rank"))


@query("win_genre_mismatch", f"WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS r FROM {_ALL_SIMS}) WHERE r <= 6), g AS (SELECT q, work % 3 AS g, count(*) AS n, min(r) AS f FROM t GROUP BY ALL), b AS (SELECT q, g, n FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, f) AS k FROM g) WHERE k = 1) SELECT q, CAST(g AS INT) AS neighbour_genre, g <> label % 3 AND n >= 4 AS mismatch FROM b JOIN embeddings ON vec_id = q")
def win_genre_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("genre"))
    near = _near_all(spark, sf_dir, 6)
    return clusters.mismatches(near, works, "vec_id", "genre").select("q", F.col("neighbour_genre").cast("int").alias("neighbour_genre"), "mismatch")


@query("agg_cluster_calibration")
def agg_cluster_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of k-means clusters with the given labels, and their sizes, for several k."""
    e = table(spark, sf_dir, "embeddings")
    out = None
    ks = [3, 4, 8]
    for k, got in zip(ks, clusters.several_kmeans(e, "vec_id", "embedding", ks)):
        named = got.select(F.col("id").alias("vec_id"), F.col("label").alias("cluster")).join(e.select("vec_id", "label"), "vec_id")
        sizes = got.groupBy("label").count().agg(F.sort_array(F.collect_list("count"), False).alias("sizes"))
        row = clusters.adjusted_rand(named, "cluster", "label").select(F.lit(k).alias("k"), F.round("ari", 4).alias("ari")).crossJoin(sizes)
        out = row if out is None else out.unionByName(row)
    return out


@query("met_works_payload")
def met_works_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The style map: two components, cluster, six nearest works, genre mismatch and period of every work."""
    e = table(spark, sf_dir, "embeddings")
    mean, basis, _ = vectors.components(e, "embedding", 2, center=True)
    xy = e.select(F.col("vec_id").alias("q"), vectors.project(F.col("embedding"), mean, basis, unit=False).alias("z"), text.period(F.lit(1930) + F.col("label") * 3).alias("pd"))
    labels = clusters.kmeans(e, "vec_id", "embedding", 8).select(F.col("id").alias("q"), F.col("label").alias("cl"))
    near = scratch(_near_all(spark, sf_dir, 6), "near")
    nb = near.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda s: s["doc"]).alias("nb"))
    mm = clusters.mismatches(near, e, "vec_id", "label").select("q", "mismatch")
    return xy.join(labels, "q").join(nb, "q").join(mm, "q").select("q", F.round(F.get("z", F.lit(0)), 3).alias("x"), F.round(F.get("z", F.lit(1)), 3).alias("y"), "cl", "nb", "mismatch", "pd")


# --- topics -------------------------------------------------------------------------------

_LABELS = "(SELECT doc_id AS doc, source, lang, CAST(substr(source, 4) AS INT) % 5 AS label FROM documents)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), "source", "lang", (F.substring("source", 4, 9).cast("int") % 5).alias("label"))


@query("agg_class_tfidf", f"WITH f AS (SELECT label, term, sum(tf) AS f FROM {_TF} JOIN {_LABELS} USING (doc) GROUP BY ALL), n AS (SELECT label, sum(f) AS n FROM f GROUP BY 1), t AS (SELECT term, sum(f) AS t FROM f GROUP BY 1), a AS (SELECT sum(n) / 5 AS a FROM n) SELECT label, term, CAST(r AS INT) AS rank, round(s, 6) AS score FROM (SELECT label, term, s, row_number() OVER (PARTITION BY label ORDER BY s DESC, term) AS r FROM (SELECT label, term, f / n * ln(1 + a / t) AS s FROM f JOIN n USING (label) JOIN t USING (term), a WHERE t >= 5)) WHERE r <= 10")
def agg_class_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.class_tfidf(topics.class_counts(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id", _words(), _labels(spark, sf_dir)), 5).select("label", "term", "rank", F.round("score", 6).alias("score"))


_COUNTS = ", ".join(f"CAST(count(*) FILTER (label = {j}) AS BIGINT) AS t{j}" for j in range(5))


@query("agg_count_vectors", f"SELECT source AS key, {_COUNTS} FROM {_LABELS} GROUP BY 1")
def agg_count_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.count_vectors(_labels(spark, sf_dir), F.col("source"), 5)


@query("agg_count_vectors_genre", f"SELECT coalesce(nullif(lang, 'en'), '不明') AS key, {_COUNTS} FROM {_LABELS} GROUP BY 1")
def agg_count_vectors_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.count_vectors(_labels(spark, sf_dir), F.coalesce(F.nullif("lang", F.lit("en")), F.lit("不明")), 5)


@query("agg_topic_sizes", f"SELECT label, CAST(count(*) AS BIGINT) AS size FROM {_LABELS} GROUP BY 1")
def agg_topic_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.sizes(_labels(spark, sf_dir))


@query("agg_representatives", "WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) AS r(i) GROUP BY ALL), s AS (SELECT e.label, vec_id AS doc, round(sum(CAST(embedding[i] AS DOUBLE) * m), 9) AS s FROM embeddings e JOIN c ON c.label = e.label GROUP BY ALL) SELECT label, doc, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, doc) AS r FROM s) WHERE r <= 3")
def agg_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("doc"), "embedding")
    return topics.representatives(e, "embedding").select("label", "doc", "rank")


@query("agg_concentration", f"WITH p AS (SELECT label, lang AS work, count(*) AS n FROM {_LABELS} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, work) AS r FROM p) SELECT label, CAST(sum(n) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS span, max(CASE WHEN r = 1 THEN work END) AS top_work, round(max(n) / sum(n), 3) AS top_share, string_agg(work, ',' ORDER BY r) AS works FROM r GROUP BY 1")
def agg_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topics.concentration(_labels(spark, sf_dir).withColumnRenamed("lang", "work"))
    return rows.withColumn("works", F.array_join("works", ","))


@query("agg_topic_shares", f"SELECT lang, label, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM (SELECT lang, label, count(*) AS n FROM {_LABELS} GROUP BY ALL)")
def agg_topic_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _labels(spark, sf_dir).groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))
    return topics.shares(counts, "lang", "label", "n").withColumn("share", rounded("share", 6))


@query("vec_topic_model")
def vec_topic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver: project, cluster, and describe vectors' topics by their sizes and representatives."""
    e = table(spark, sf_dir, "embeddings")
    mean, basis, _ = vectors.components(e, "embedding", 32)
    z = scratch(e.select(F.col("vec_id").alias("doc"), vectors.project(F.col("embedding"), mean, basis).alias("z")), "projected")
    labels = clusters.kmeans(z, "doc", "z", 10).withColumnRenamed("id", "doc")
    reps = topics.representatives(z.join(labels, "doc"), "z").groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc"))), lambda s: s["doc"]).alias("reps"))
    return topics.sizes(labels).join(reps, "label")


# --- mentions -----------------------------------------------------------------------------

_NAMES = "(SELECT doc_id AS doc, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS term FROM documents) GROUP BY ALL)"
_W = f"n AS {_NAMES}, c AS (SELECT count(DISTINCT doc) AS c FROM n), d AS (SELECT term, count(*) AS df FROM n GROUP BY 1), x AS (SELECT doc, term, (1 + ln(tf)) * ln(c / df) AS x FROM n JOIN d USING (term), c WHERE df >= 2 AND df <= c * 0.25), w AS (SELECT doc, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM x)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.term_frequencies(_docs(spark, sf_dir), "doc_id", F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))


@query("agg_proper_nouns", f"SELECT doc, term, tf FROM {_NAMES}")
def agg_proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir)


@query("agg_mention_weights", f"WITH {_W} SELECT doc, term, round(w, 6) AS w FROM w")
def agg_mention_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.weights(_names(spark, sf_dir)).withColumn("w", F.round("w", 6))


@query("flt_document_frequency", f"WITH n AS {_NAMES} SELECT term, CAST(count(*) AS BIGINT) AS df FROM n GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.25 * (SELECT count(DISTINCT doc) FROM n)")
def flt_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = _names(spark, sf_dir)
    n = tf.agg(F.countDistinct("doc").alias("n"))
    df = search.document_frequencies(tf).crossJoin(F.broadcast(n))
    return df.where((F.col("df") >= mentions.MIN_DF) & (F.col("df") <= F.col("n") * mentions.MAX_DF)).select("term", "df")


@query("jon_shared_names", f"WITH {_W} SELECT x.doc AS a, y.doc AS b, round(sum(x.w * y.w), 6) AS w FROM w x JOIN w y ON x.term = y.term AND x.doc < y.doc GROUP BY ALL HAVING sum(x.w * y.w) >= 0.08")
def jon_shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.edges(mentions.weights(_names(spark, sf_dir))).withColumn("w", F.round("w", 6))


_CLIQUES = [(a, b, 1.0) for lo in (0, 5) for a in range(lo, lo + 5) for b in range(a + 1, lo + 5)] + [(4, 5, 0.05)]


@query("vec_communities", f"SELECT CAST(node AS INT) AS node, CAST(c AS BIGINT) AS community FROM {sql_values([(i, i // 5) for i in range(10)], 'node, c')}")
def vec_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = values(spark, _CLIQUES, "a int, b int, w double")
    nodes = values(spark, [(i,) for i in range(10)], "node int")
    return mentions.communities(edge, nodes).select("node", "community")


@query("agg_community_profile", f"WITH n AS {_NAMES}, m AS (SELECT doc_id AS doc, CAST(substr(source, 4) AS BIGINT) AS community FROM documents), s AS (SELECT community, count(*) AS size FROM m GROUP BY 1 HAVING count(*) >= 3), g AS (SELECT term, count(*) AS df FROM n GROUP BY 1), i AS (SELECT community, term, count(*) AS c FROM n JOIN m USING (doc) GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT community, term, row_number() OVER (PARTITION BY community ORDER BY round(c / size * ln((SELECT count(*) FROM m) / df), 9) DESC, term) AS r FROM i JOIN s USING (community) JOIN g USING (term)) SELECT community, term, CAST(r AS INT) AS rank FROM r WHERE r <= 12")
def agg_community_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.substring("source", 4, 9).cast("long").alias("community"))
    return mentions.profile(members, _names(spark, sf_dir)).select("community", "term", "rank")


@query("vec_mention_graph")
def vec_mention_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver: communities of all works by names they share, of three works at least."""
    edge = mentions.edges(mentions.weights(_names(spark, sf_dir)))
    nodes = _docs(spark, sf_dir).select(F.col("doc_id").alias("node"))
    got = scratch(mentions.communities_in_rounds(edge, nodes), "communities")
    sizes = got.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return got.join(sizes, "community").where("size >= 3").select(F.col("node").alias("doc"), "community", "size")


_MEMBERS = "m AS (SELECT doc_id AS doc, CAST(substr(source, 4) AS BIGINT) AS community, n_chars AS chars, coalesce(lang, '不明') AS genre, CASE WHEN doc_id % 3 <> 0 THEN 1900 + doc_id % 50 END AS year FROM documents), s AS (SELECT community, count(*) AS size FROM m GROUP BY 1 HAVING count(*) >= 3)"
_RANKED = "g AS (SELECT term, count(*) AS df FROM n GROUP BY 1), i AS (SELECT community, term, count(*) AS c FROM n JOIN m USING (doc) GROUP BY ALL HAVING count(*) >= 2), r AS (SELECT community, term, row_number() OVER (PARTITION BY community ORDER BY round(c / size * ln((SELECT count(*) FROM m) / df), 9) DESC, term) AS r FROM i JOIN s USING (community) JOIN g USING (term))"
_PARTS = "a AS (SELECT community, string_agg(term, '|' ORDER BY r) AS names FROM r WHERE r <= 12 GROUP BY 1), b AS (SELECT community, string_agg(doc, '|' ORDER BY r) AS works FROM (SELECT community, doc, row_number() OVER (PARTITION BY community ORDER BY coalesce(chars, 0) DESC, doc) AS r FROM m) WHERE r <= 12 GROUP BY 1), e AS (SELECT community, string_agg(genre || ':' || n, '|' ORDER BY n DESC, genre) AS genres FROM (SELECT community, genre, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1), y AS (SELECT community, string_agg(year || ':' || n, '|' ORDER BY year) AS years FROM (SELECT community, year, count(*) AS n FROM m WHERE year IS NOT NULL GROUP BY ALL) GROUP BY 1)"


def _told(rows: DataFrame) -> DataFrame:
    """The lists of a report as text."""
    pairs = lambda c, k: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s[k].cast("string"), s["n"].cast("string"))), "|").alias(c)
    return rows.select("community", "size", F.array_join("names", "|").alias("names"), F.array_join(F.col("works").cast("array<string>"), "|").alias("works"), pairs("genres", "genre"), pairs("years", "year"))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return _docs(spark, sf_dir).select(i.alias("doc"), F.col("n_chars").alias("chars"), F.col("lang").alias("genre"), F.when(i % 3 != 0, 1900 + i % 50).alias("year"))


@query("agg_community_report", f"WITH n AS {_NAMES}, {_MEMBERS}, {_RANKED}, {_PARTS} SELECT community, size, coalesce(names, '') AS names, works, genres, coalesce(years, '') AS years FROM s LEFT JOIN a USING (community) LEFT JOIN b USING (community) LEFT JOIN e USING (community) LEFT JOIN y USING (community)")
def agg_community_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, longest works, genres and years of the documents of each source."""
    members = _docs(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.substring("source", 4, 9).cast("long").alias("community"))
    return _told(mentions.reports(members, _names(spark, sf_dir), _catalogue(spark, sf_dir)))


@query("vec_mention_report")
def vec_mention_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole driver: names, edges, communities in rounds, a report of each of three works at least, and the totals in every row."""
    tf, docs = scratch(_names(spark, sf_dir), "names"), _docs(spark, sf_dir).select(F.col("doc_id").alias("node"))
    edge = scratch(mentions.edges(mentions.weights(tf)), "edges")
    members = scratch(mentions.communities_in_rounds(edge, docs, stored=True).select(F.col("node").alias("doc"), "community"), "members")
    return _told(mentions.reports(members, tf, _catalogue(spark, sf_dir))).crossJoin(F.broadcast(mentions.summary(members, edge)))


# --- time ---------------------------------------------------------------------------------

_DAYS = "(SELECT event_type AS grp, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS t, avg(value) AS x FROM events GROUP BY ALL)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")))
    return e.groupBy(F.col("event_type").alias("grp"), "t").agg(F.avg("value").alias("x"))


@query("win_split_cost", f"SELECT grp, t, round(sq - CASE WHEN i > 1 THEN a * a / (i - 1) ELSE 0 END - (s - a) * (s - a) / (n - i + 1), 4) AS cost FROM (SELECT grp, t, row_number() OVER w AS i, count(*) OVER (PARTITION BY grp) AS n, sum(x) OVER w - x AS a, sum(x) OVER (PARTITION BY grp) AS s, sum(x * x) OVER (PARTITION BY grp) AS sq FROM {_DAYS} WINDOW w AS (PARTITION BY grp ORDER BY t))")
def win_split_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changepoint.split_costs(_days(spark, sf_dir), "grp", "t", "x").withColumn("cost", F.round("cost", 4))


@query("agg_year_series", f"WITH m AS (SELECT CAST(1900 + doc_id % 40 AS INT) AS year, avg(n_chars) AS x FROM documents GROUP BY 1) SELECT year, round((x - (SELECT avg(x) FROM m)) / (SELECT CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END FROM m), 6) AS x FROM m")
def agg_year_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select((1900 + F.col("doc_id") % 40).cast("int").alias("y"), F.col("n_chars").cast("double").alias("x"))
    return changepoint.year_series(d, "y", ["x"]).withColumn("x", F.round("x", 6))


def _steps() -> list[tuple[str, int, float]]:
    rng = np.random.default_rng(11)
    step = np.r_[np.zeros(30), np.full(40, 4.0), np.full(30, -3.0)] + rng.normal(0, 0.4, 100)
    return [("step", i, float(x)) for i, x in enumerate(step)] + [("noise", i, float(x)) for i, x in enumerate(rng.normal(0, 1, 100))]


@query("vec_change_points", f"SELECT * FROM {sql_values([('step', 30), ('step', 70)], 'grp, i')}")
def vec_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = values(spark, _steps(), "grp string, t int, x double")
    return changepoint.change_points(series, "grp", "t", ["x"]).select("grp", F.col("index").alias("i"))


@query("jon_near_years", "SELECT o_orderkey, y FROM (SELECT o_orderkey, CAST(1925 + o_orderkey % 30 AS INT) AS t FROM orders) JOIN (VALUES (1931), (1938), (1946), (1950)) AS v(y) ON abs(t - y) <= 1")
def jon_near_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").select("o_orderkey", (1925 + F.col("o_orderkey") % 30).cast("int").alias("t"))
    return changepoint.near(points, values(spark, [(1931,), (1938,), (1946,), (1950,)], "y int"), "t", "y").select("o_orderkey", "y")


@query("vec_change_driver", f"SELECT grp, CAST(i AS INT) AS \"index\", CAST(t AS INT) AS t FROM {sql_values([('all', 30, 30), ('all', 70, 70)], 'grp, i, t')}")
def vec_change_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series side by side, standardised, on their principal components, with change points of all of them together; two are planted."""
    wide = values(spark, _steps(), "grp string, t int, x double").groupBy("t").pivot("grp", ["step", "noise"]).agg(F.first("x"))
    wide = wide.withColumn("echo", F.col("step") * 0.5 + F.col("noise") * 0.1)
    cols = [c for c in wide.columns if c != "t"]
    z = changepoint.principal_series(clusters.standardize(wide, cols), "t", cols)
    return changepoint.change_points(z.withColumn("grp", F.lit("all")), "grp", "t", [c for c in z.columns if c != "t"])


# --- retrieval metrics --------------------------------------------------------------------

_GOLD = f"WITH s AS {_SIMS}, k AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS rank FROM s WHERE doc % 10 <> 5), g AS (SELECT q, (SELECT min(rank) FROM k WHERE k.q = z.q AND k.doc IN (z.q + 1, z.q + 3) AND rank <= 101) AS rank FROM (SELECT DISTINCT q FROM s) z)"


def _gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query the rows 1 and 3 on are right; rows of skipped works (those that end in 5) are not counted."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0")
    gold = asked.select(F.col("vec_id").alias("q"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 3)).alias("doc"))
    placed = search.ranks(e.where("vec_id % 10 <> 5"), asked, gold, "vec_id", "embedding")
    return metrics.gold_ranks(placed, gold).select("q", F.col("rank").cast("int").alias("rank"))


@query("win_gold_rank", f"{_GOLD} SELECT q, CAST(rank AS INT) AS rank FROM g")
def win_gold_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold_ranks(spark, sf_dir)


@query("agg_retrieval_metrics", f"{_GOLD} SELECT CAST(count(*) AS BIGINT) AS n, round(count(*) FILTER (rank <= 1) / count(*), 4) AS recall1, round(count(*) FILTER (rank <= 5) / count(*), 4) AS recall5, round(count(*) FILTER (rank <= 10) / count(*), 4) AS recall10, round(sum(coalesce(1.0 / rank, 0)) / count(*), 4) AS mrr, CAST(floor(median(rank)) AS INT) AS median_rank FROM g")
def agg_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_gold_ranks(spark, sf_dir))


@query("jon_gold_twins", "SELECT DISTINCT q, doc FROM (SELECT vec_id AS q, vec_id + 1 AS doc FROM embeddings UNION ALL SELECT vec_id, vec_id + 2 FROM embeddings WHERE (vec_id + 1) % 2 = 0 UNION ALL SELECT vec_id, vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def jon_gold_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold is the next vector; even vectors and the ones after them are twins."""
    e = table(spark, sf_dir, "embeddings")
    gold = e.select(F.col("vec_id").alias("q"), (F.col("vec_id") + 1).alias("doc"))
    n = e.agg(F.max("vec_id").alias("n"))
    ids = e.select(F.col("vec_id").alias("a")).union(n.select(F.col("n") + 1))
    return metrics.with_twins(gold, ids.where("a % 2 = 0").select("a", (F.col("a") + 1).alias("b")))


@query("agg_index_quantiles", "SELECT l[CAST(floor(len(l) * 0.1) AS INT) + 1] AS p10, l[CAST(floor(len(l) * 0.5) AS INT) + 1] AS p50, l[CAST(floor(len(l) * 0.9) AS INT) + 1] AS p90 FROM (SELECT list_sort(list(n_chars)) AS l FROM documents)")
def agg_index_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranked_quantiles(_docs(spark, sf_dir), "n_chars", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


_WORDS = "regexp_extract_all(text, '[^ \\t\\n\\r]+')"


@query(
    "agg_anti_leak",
    f"WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), i AS (SELECT DISTINCT item_id, w[k:k + least(len(w), 8) - 1] AS g FROM b, range(1, 100000) AS r(k) WHERE len(w) > 0 AND k <= greatest(len(w) - 7, 1)), d AS (SELECT doc_id, {_WORDS} AS w FROM documents), n AS (SELECT DISTINCT len(g) AS n FROM i), s AS (SELECT DISTINCT doc_id, w[k:k + n - 1] AS g FROM d, n, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)) SELECT item_id, CAST(count(DISTINCT doc_id) AS BIGINT) AS n FROM i JOIN s USING (g) GROUP BY 1",
)
def agg_anti_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share any run of 8 words with an evaluation item; the whole of an item of fewer."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return mentions.shared_runs(table(spark, sf_dir, "benchmark"), docs, 8).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n"))
