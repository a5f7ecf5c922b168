"""Queries of event logs, corpus summaries, filters, orders and sets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import eventlog, search
from textloom.operators.ranking import dense_ordinal
from textloom.plans.registry import query, sql_values, table, values
from textloom.sources import sinks


def _line(event: str | None, ts: str, loop: str = "loop_001", project: str = "p", v: str = "1.2", **data) -> str:
    record = {"v": v, "ts": f"2026-01-01T{ts}:00+09:00", "project": project, "loop_id": loop, "event": event, "data": data}
    return json.dumps({k: x for k, x in record.items() if x is not None}, ensure_ascii=False)


_START = {"goal": "g", "spec_refs": ["F-1"], "scaffold_version": "1", "agent": "a"}
_FAIL = {"code": "E1", "severity": "high", "detected_stage": 2, "summary": "s", "resolution": "fixed"}
_GOOD = "\n".join([
    _line("loop_start", "09:00", **_START),
    _line("test_run", "09:10", command="t", passed=3, failed=1),
    _line("failure", "09:20", **_FAIL),
    "",
    _line("failure", "09:30", **(_FAIL | {"code": "E2", "harness_ref": "HC-1", "resolution": "harness_fix"})),
    _line("correction", "09:40", supersedes=3, reason="wrong"),
    _line("failure", "09:50", **_FAIL),
    _line("commit", "10:00", sha="abc", kind="feat"),
    _line("test_run", "10:10", command="t", passed=4, failed=0),
    _line("loop_end", "10:20", outcome="success", failure_count=2, summary="done"),
    _line("correction", "10:30", supersedes=8, reason="typo"),
    _line("commit", "10:40", sha="abd", kind="feat"),
])
_BAD = "\n".join([
    _line("test_run", "09:00", "loop_002", command="t", passed="three", failed=0),
    "{not json",
    _line("wonder", "08:00", "loop_002"),
    _line("failure", "09:20", "loop_009", "q", **(_FAIL | {"code": "E9", "resolution": "harness_fix"})),
    _line("stage_end", "09:30", "loop_002", stage=1, stage_name="x", result="maybe"),
    _line("correction", "09:40", "loop_002", supersedes=99, reason="none"),
    _line("correction", "09:41", "loop_002", supersedes=6, reason="of a correction"),
    _line("loop_end", "09:50", "loop_002", outcome="success", failure_count=5, summary="x"),
    _line("commit", "09:55", "loop_002", sha="z", kind="feat"),
    _line("loop_start", "09:56", "loop_002", "loop_002", **_START),
    json.dumps({"v": "1.2", "ts": "2026-01-01T09:59:00+09:00"}),
])


def _log(spark: SparkSession) -> DataFrame:
    return eventlog.read_log(values(spark, [("loop_001.jsonl", _GOOD), ("loop_002.jsonl", _BAD)], "file string, text string"))


_LINES = [(i, x) for i, x in enumerate(_GOOD.split("\n"), 1) if x]


@query("log_reader", f"SELECT CAST(line AS INT) AS line, json_extract_string(raw, '$.event') AS event FROM {sql_values(_LINES, 'line, raw')}")
def log_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark).where("file = 'loop_001.jsonl'").select("line", "event")


_ERRORS = [(1, "type", "passed"), (2, "json", ""), (3, "event", "wonder"), (4, "code", "E9"), (4, "harness_ref", ""), (5, "enum", "result"), (11, "envelope", "data"), (11, "envelope", "event"), (11, "envelope", "loop_id"), (11, "envelope", "project")]


@query("log_record_errors", f"SELECT 'loop_002.jsonl' AS file, line, rule, detail FROM {sql_values(_ERRORS, 'line, rule, detail')}")
def log_record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = values(spark, [("E1",), ("E2",)], "code string")
    return eventlog.record_errors(_log(spark), codes, ("high", "low"), ("fixed", "harness_fix"))


_FILE_ERRORS = [
    ("loop_002.jsonl", 4, "loop_id"), ("loop_002.jsonl", 0, "time_order"), ("loop_002.jsonl", 10, "project_is_loop"), ("loop_002.jsonl", 0, "projects_mixed"),
    ("loop_002.jsonl", 0, "first_is_start"), ("loop_002.jsonl", 0, "after_end"), ("loop_002.jsonl", 0, "failure_count"), ("loop_002.jsonl", 6, "correction"), ("loop_002.jsonl", 7, "correction"),
]


@query("log_file_errors", f"SELECT * FROM {sql_values(_FILE_ERRORS, 'file, line, rule')}")
def log_file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.file_errors(_log(spark))


_VERDICTS = [("loop_001.jsonl", 6, 3, "voids"), ("loop_001.jsonl", 11, 8, "voids"), ("loop_002.jsonl", 6, 99, "no_record"), ("loop_002.jsonl", 7, 6, "is_correction")]


@query("jon_corrections", f"SELECT * FROM {sql_values(_VERDICTS, 'file, line, target, verdict')}")
def jon_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.corrections(_log(spark)).select("file", "line", "target", "verdict")


@query("agg_voided_counts", f"SELECT file, event, CAST(n AS BIGINT) AS n FROM {sql_values([('loop_001.jsonl', 'failure', 1), ('loop_001.jsonl', 'commit', 1), ('loop_002.jsonl', 'correction', 1)], 'file, event, n')}")
def agg_voided_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.voided_counts(_log(spark))


def _live(spark: SparkSession) -> DataFrame:
    return eventlog.effective(_log(spark)).where("file = 'loop_001.jsonl'")


@query("agg_fact_loops", "SELECT 'p' AS project, 'loop_001' AS loop_id, '2026-01-01T09:00:00+09:00' AS started_at, '2026-01-01T10:20:00+09:00' AS ended_at, 'g' AS goal, '1' AS scaffold_version, 'a' AS agent, 'success' AS outcome, CAST(2 AS BIGINT) AS n_failures, CAST(1 AS BIGINT) AS n_commits, CAST(2 AS BIGINT) AS n_test_runs, 4 AS last_tests_passed, 0 AS last_tests_failed")
def agg_fact_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.fact_loops(_live(spark))


_FACTS = [("E2", "high", 2, "harness_fix", "HC-1"), ("E1", "high", 2, "fixed", None)]


@query("agg_fact_failures", f"SELECT * FROM {sql_values(_FACTS, 'code, severity, detected_stage, resolution, harness_ref')}")
def agg_fact_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventlog.fact_failures(_live(spark)).select("code", "severity", "detected_stage", "resolution", "harness_ref")


_EVENTS = ("loop_start", "test_run", "failure", "commit", "loop_end", "stage_end")


def _loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as records of loops, a file for each user."""
    i = F.col("event_id")
    data = F.to_json(F.struct(
        F.concat(F.lit("goal "), i.cast("string")).alias("goal"), F.lit("1").alias("scaffold_version"), F.col("event_type").alias("outcome"), F.col("event_type").alias("severity"),
        (i % 9).alias("passed"), (i % 4).alias("failed"), F.concat(F.lit("E"), (i % 5).cast("string")).alias("code"), F.concat(F.lit("said "), i.cast("string")).alias("summary"),
    ))
    event = F.element_at(F.array(*map(F.lit, _EVENTS)), (i % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("loop_"), F.col("user_id").cast("string")).alias("file"), i.alias("line"), F.col("event_type").alias("project"), event.alias("event"), data.alias("data"))


def _nth(of: str, what: str, k: int) -> str:
    return f"{of}({what}, event_id) FILTER (WHERE event_id % 6 = {k})"


@query("agg_loop_summary", f"SELECT 'loop_' || user_id AS file, {_nth('arg_min', 'event_type', 0)} AS project, {_nth('arg_min', chr(39) + 'goal ' + chr(39) + ' || event_id', 0)} AS goal, {_nth('arg_min', 'event_type', 4)} AS outcome, {_nth('arg_min', chr(39) + 'said ' + chr(39) + ' || event_id', 4)} AS summary, count(*) FILTER (WHERE event_id % 6 = 1) AS n_test_runs, CAST({_nth('arg_max', 'event_id % 9', 1)} AS INT) AS passed, CAST({_nth('arg_max', 'event_id % 4', 1)} AS INT) AS failed, count(*) FILTER (WHERE event_id % 6 = 3) AS n_commits, count(*) FILTER (WHERE event_id % 6 = 2) AS n_failures FROM events GROUP BY 1")
def agg_loop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events summed up as a loop."""
    return eventlog.loop_summary(_loops(spark, sf_dir)).select("file", "project", "goal", "outcome", "summary", "n_test_runs", "passed", "failed", "n_commits", "n_failures")


@query("agg_failure_lines", "SELECT 'loop_' || user_id AS file, event_id AS line, event_type AS severity, 'E' || event_id % 5 AS code, coalesce(r_name, '?') AS name, 'said ' || event_id AS summary FROM events LEFT JOIN region ON r_regionkey = event_id % 5 AND r_regionkey < 4 WHERE event_id % 6 = 2")
def agg_failure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failures of a summary, each with the name of its code; one code has none."""
    codes = table(spark, sf_dir, "region").where("r_regionkey < 4").select(F.concat(F.lit("E"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("name"))
    return eventlog.failure_lines(_loops(spark, sf_dir), codes).select("file", "line", "severity", "code", "name", "summary")


@query("snk_key_union", "SELECT key, row_number() OVER (ORDER BY least(a, b)) - 1 AS place FROM (SELECT key, min(a) AS a, min(b) AS b FROM (SELECT event_type AS key, event_id * 2 AS a, NULL AS b FROM events UNION ALL SELECT 'user' || user_id % 10, NULL, event_id * 2 + 1 FROM events) GROUP BY 1)")
def snk_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of all events as records of unlike keys: keys in order of first use."""
    maps = table(spark, sf_dir, "events").select("event_id", F.create_map("event_type", F.col("value").cast("string"), F.concat(F.lit("user"), (F.col("user_id") % 10).cast("string")), F.lit("1")).alias("data"))
    return values(spark, [(k, i) for i, k in enumerate(sinks.union_of_keys(maps, [F.col("event_id")], "data"))], "key string, place long")


@query("agg_two_strike", "SELECT event_type AS code, CAST(count(*) AS BIGINT) AS total, count(*) >= 2 AS needs_hc, bool_or(event_id % 500 = 0) AS has_hc_ref FROM events GROUP BY 1")
def agg_two_strike(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), F.when(F.col("event_id") % 500 == 0, "HC").alias("harness_ref"))
    return eventlog.two_strike(e)


@query("win_running_failures", "SELECT event_id, CAST(count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far FROM events")
def win_running_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("code"), F.col("event_id").alias("loop_id"))
    return eventlog.running_failures(e).select("event_id", "so_far")


@query("jon_taxonomy", "SELECT event_id, name FROM events JOIN (VALUES ('click', 'Click'), ('view', 'View'), ('purchase', 'Purchase')) AS t(code, name) ON code = event_type")
def jon_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = values(spark, [("click", "Click"), ("view", "View"), ("purchase", "Purchase")], "code string, name string")
    return table(spark, sf_dir, "events").join(F.broadcast(dim), F.col("event_type") == F.col("code")).select("event_id", "name")


@query("txt_log_flatten", f"SELECT CAST(line AS INT) AS line, json_extract_string(raw, '$.data.goal') AS data_goal, json_extract_string(raw, '$.data.passed') AS data_passed FROM {sql_values([x for x in _LINES if 'supersedes' not in x[1] and x[0] not in (3, 8)], 'line, raw')}")
def txt_log_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _live(spark)
    flat = eventlog.flatten(live, ["goal", "passed"]).select("ts", "data_goal", "data_passed")
    return live.select("ts", "line").join(flat, "ts").select("line", "data_goal", "data_passed")


@query("log_append", "SELECT 'loop_001.jsonl' AS file, false AS accepted UNION ALL SELECT 'loop_003.jsonl', true")
def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record behind an ended loop is refused, a new loop's start is taken."""
    new = eventlog.read_log(values(spark, [("loop_001.jsonl", "\n" * 20 + _line("escalation", "11:00", reason="r", question="q")), ("loop_003.jsonl", _line("loop_start", "09:00", "loop_003", **_START))], "file string, text string"))
    taken, _ = eventlog.append(_log(spark), new)
    return new.select("file").distinct().join(taken.select("file", F.lit(True).alias("ok")).distinct(), "file", "left").select("file", F.coalesce("ok", F.lit(False)).alias("accepted"))


# --- corpus summary, filters, orders, sets ------------------------------------------------


@query("agg_corpus_summary", "SELECT CAST(count(*) AS BIGINT) AS listed, CAST(sum(n_chars) AS BIGINT) AS chars_total, CAST(max(n_chars) AS BIGINT) AS chars_max, CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS en, CAST(min(doc_id) AS BIGINT) AS low, CAST(max(doc_id) AS BIGINT) AS high, CAST(count(*) FILTER (lang IS NULL) AS BIGINT) AS unknown FROM documents")
def agg_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("listed"), F.sum("n_chars").alias("chars_total"), F.max("n_chars").alias("chars_max"), F.count_if(F.col("lang") == "en").alias("en"),
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("lang").isNull()).alias("unknown"),
    )


@query("agg_histograms", "SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS kind, coalesce(lang, source) AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def agg_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several histograms in one pass."""
    d = table(spark, sf_dir, "documents")
    g = d.groupingSets([["lang"], ["source"]], "lang", "source").agg(F.grouping("lang").alias("g"), F.count(F.lit(1)).alias("n"))
    return g.select(F.when(F.col("g") == 0, "lang").otherwise("source").alias("kind"), F.coalesce("lang", "source").alias("value"), "n")


@query("agg_timeline", "SELECT CAST(d AS DATE) AS day, t AS event_type, CAST(count(event_id) AS BIGINT) AS n FROM (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS d FROM events), (SELECT DISTINCT event_type AS t FROM events) LEFT JOIN events ON CAST(ts AS DATE) = d AND event_type = t GROUP BY ALL")
def agg_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day and type, with zeros for days without events."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    counts = e.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))
    days = counts.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    grid = days.crossJoin(counts.select("event_type").distinct())
    return grid.join(counts, ["day", "event_type"], "left").na.fill(0, ["n"])


@query("flt_works_list", "SELECT doc_id FROM documents WHERE contains(source, '1') AND coalesce(lang, '不明') = 'en' AND n_chars > 500")
def flt_works_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional predicates; those given are pushed to the scan."""
    given = {"title": "1", "genre": "en", "least": 500}
    rows = table(spark, sf_dir, "documents")
    if given["title"]:
        rows = rows.where(F.col("source").contains(given["title"]))
    if given["genre"]:
        rows = rows.where(F.coalesce("lang", F.lit("不明")) == given["genre"])
    if given["least"]:
        rows = rows.where(F.col("n_chars") > given["least"])
    return rows.select("doc_id")


@query("flt_community_size", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE source NOT IN ('src0') GROUP BY 1 HAVING count(*) >= 3")
def flt_community_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(~F.col("source").isin("src0")).groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query("flt_minimum_total", "SELECT doc, term FROM (SELECT doc, term, sum(n) OVER (PARTITION BY term) AS total FROM (SELECT doc_id AS doc, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) GROUP BY ALL)) WHERE total >= 5")
def flt_minimum_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, terms = table(spark, sf_dir, "documents"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    tf = search.term_frequencies(docs, "doc_id", terms)
    frequent = docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total")).where("total >= 5")
    return tf.join(frequent.select("term"), "term", "left_semi").select("doc", "term")


@query("flt_stop_words", "SELECT w AS term, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) WHERE lower(w) NOT IN ('the', 'of', 'and') AND length(w) >= 2 GROUP BY 1")
def flt_stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("term"))
    return w.where(~F.lower("term").isin("the", "of", "and") & (F.length("term") >= 2)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("flt_edge_weight", "SELECT user_id, event_type, round(sum(value), 4) AS w FROM events GROUP BY ALL HAVING sum(value) >= 50")
def flt_edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("w")).where("w >= 50").withColumn("w", F.round("w", 4))


@query("jon_work_metadata", "SELECT d.doc_id, quality, toxic FROM documents d JOIN labels USING (doc_id)")
def jon_work_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")


@query("jon_semi_anti", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def jon_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, keys = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(keys, "doc_id", "left_semi").withColumn("labelled", F.lit(True)).union(d.join(keys, "doc_id", "left_anti").withColumn("labelled", F.lit(False)))


@query("jon_paragraph_passage", "SELECT conv_id, p, max(k) AS passage FROM (SELECT conv_id, turn AS k, unnest(range(turn, turn + 3)) AS p FROM conversations) JOIN (SELECT conv_id, max(turn) AS final FROM conversations GROUP BY 1) USING (conv_id) WHERE p <= final GROUP BY ALL")
def jon_paragraph_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs to passages whose spans hold them; the later passage wins."""
    spans = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("k"), F.explode(F.sequence(F.col("turn"), F.col("turn") + 2)).alias("p"))
    final = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("final"))
    return spans.join(final, "conv_id").where("p <= final").groupBy("conv_id", "p").agg(F.max("k").alias("passage"))


@query("win_time_order", "SELECT CAST(count(*) FILTER (ts < before) AS BIGINT) AS back, bool_and(first_id = event_id OR n > 1) AS starts FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS first_id FROM events)")
def win_time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(by)).withColumn("n", F.row_number().over(by)).withColumn("first_id", F.first("event_id").over(by))
    return e.agg(F.count_if(F.col("ts") < F.col("before")).alias("back"), F.bool_and((F.col("first_id") == F.col("event_id")) | (F.col("n") > 1)).alias("starts"))


@query("win_repair_slots", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events) JOIN (SELECT event_type, CAST(count(*) % 7 AS INT) AS budget FROM events GROUP BY 1) USING (event_type) WHERE nth <= budget")
def win_repair_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nth event of a type is allowed up to the type's budget."""
    e = table(spark, sf_dir, "events")
    budget = e.groupBy("event_type").agg((F.count(F.lit(1)) % 7).cast("int").alias("budget"))
    nth = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return e.withColumn("nth", nth).join(budget, "event_type").where("nth <= budget").select("event_id")


@query("win_prefix_sums", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS s FROM events")
def win_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(by), 4).alias("s"))


@query("top_most_common", "SELECT source, n, CAST(r AS INT) AS rank FROM (SELECT source, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS r FROM documents GROUP BY 1) WHERE r <= 5")
def top_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest sources, the one met first on a tie."""
    c = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).where("rank <= 5").select("source", "n", "rank")


@query("top_nulls_last", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY k DESC NULLS LAST, c_custkey) AS INT) AS down, CAST(row_number() OVER (ORDER BY k ASC NULLS LAST, c_custkey) AS INT) AS up FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer)")
def top_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    down = dense_ordinal(k, [F.col("k").desc_nulls_last(), F.col("c_custkey")], "down")
    both = dense_ordinal(down, [F.col("k").asc_nulls_last(), F.col("c_custkey")], "up")
    return both.select("c_custkey", (F.col("down") + 1).cast("int").alias("down"), (F.col("up") + 1).cast("int").alias("up"))


@query("top_unknown_year", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN CAST(1900 + o_orderkey % 50 AS INT) END, 9999) AS y FROM orders ORDER BY y, o_orderkey LIMIT 20")
def top_unknown_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.coalesce(F.when(F.col("o_orderkey") % 5 > 0, (1900 + F.col("o_orderkey") % 50).cast("int")), F.lit(9999))
    return table(spark, sf_dir, "orders").select("o_orderkey", y.alias("y")).orderBy("y", "o_orderkey").limit(20)


@query("set_overlap", "WITH w AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents) SELECT a.doc_id, round(len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(list_concat(a.w, b.w))), 1), 6) AS j FROM w a JOIN w b ON b.doc_id = a.doc_id + 1")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared over all words of each document and the next."""
    from textloom.functions.numbers import rounded
    from textloom.functions.text import jaccard

    w = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    nxt = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return w.join(nxt, "doc_id").select("doc_id", rounded(jaccard(F.col("w"), F.col("v")), 6).alias("j"))


@query("set_union_ids", "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def set_union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.union(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("set_difference", "SELECT 'only_documents' AS side, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT 'only_labels', CAST(count(*) AS BIGINT) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    side = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return side(a.exceptAll(b), "only_documents").union(side(b.exceptAll(a), "only_labels"))


@query("snk_payload_json", "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}' AS payload FROM documents")
def snk_payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("payload"))
