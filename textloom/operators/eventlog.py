"""Event logs: records of an append-only JSON-lines log, corrected, validated and summed up.

A record is (file, line, v, ts, project, loop_id, event, data), data being JSON
text. Rules are columns and joins; a broken rule is a row, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "v string, ts string, project string, loop_id string, event string, data string"
ENVELOPE = ("v", "ts", "project", "loop_id", "event", "data")
# The required fields of each event with their JSON types, and the enumerations.
REQUIRED = {
    "loop_start": {"goal": "string", "spec_refs": "array", "scaffold_version": "string", "agent": "string"},
    "stage_end": {"stage": "int", "stage_name": "string", "result": "string"},
    "test_run": {"command": "string", "passed": "int", "failed": "int"},
    "failure": {"code": "string", "severity": "string", "detected_stage": "int", "summary": "string", "resolution": "string"},
    "escalation": {"reason": "string", "question": "string"},
    "commit": {"sha": "string", "kind": "string"},
    "loop_end": {"outcome": "string", "failure_count": "int", "summary": "string"},
    "correction": {"supersedes": "int", "reason": "string"},
}
ENUMS = {
    ("stage_end", "result"): ("pass", "fail", "skip"),
    ("loop_end", "outcome"): ("success", "partial", "aborted"),
    ("commit", "kind"): ("feat", "fix", "test", "docs", "refactor", "chore", "data", "spec"),
}
STRICT_FROM = (1, 2)


def read_log(texts: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """Whole files as records with their physical line numbers; blank lines are skipped, `bad` marks lines that are no JSON object.

    `type_<field>` hold the JSON types of the data fields that rules ask for.
    """
    lines = texts.select(F.col(file_col).alias("file"), F.posexplode(F.split(F.col(text_col), "\r?\n")).alias("line", "raw")).withColumn("line", F.col("line") + 1)
    lines = lines.where("trim(raw) != ''").withColumn("j", F.try_parse_json("raw"))
    get = lambda k: F.try_variant_get("j", f"$.{k}", "string").alias(k)
    kind = F.coalesce(F.schema_of_variant("j"), F.lit("VOID"))
    return lines.select("file", "line", "raw", (~kind.startswith("OBJECT")).alias("bad"), *[get(k) for k in ENVELOPE])


def field(name: str, kind: str = "string") -> Column:
    """A field of a record's data."""
    return F.try_variant_get(F.try_parse_json("data"), f"$.{name}", kind)


def _json_type(name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json("data"), f"$.{name}", "variant"))


def _has_type(name: str, kind: str) -> Column:
    t = _json_type(name)
    return {"string": t == "STRING", "int": t.isin("BIGINT", "BOOLEAN"), "array": t.startswith("ARRAY")}[kind]


def record_errors(records: DataFrame, codes: DataFrame | None = None, severities: tuple[str, ...] = (), resolutions: tuple[str, ...] = ()) -> DataFrame:
    """(file, line, rule, detail): what single records break. `codes` is (code) of the taxonomy."""
    good = records.where("not bad")
    bad = records.where("bad").select("file", "line", F.lit("json").alias("rule"), F.lit("").alias("detail"))
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ENVELOPE]))
    rows = good.withColumn("lacks", lacks)
    envelope = rows.select("file", "line", F.lit("envelope").alias("rule"), F.explode("lacks").alias("detail"))
    whole = rows.where(F.size("lacks") == 0)
    unknown = whole.where(~F.col("event").isin(*REQUIRED)).select("file", "line", F.lit("event").alias("rule"), F.col("event").alias("detail"))
    known = whole.where(F.col("event").isin(*REQUIRED))
    checks: list[Column] = []
    for event, fields in REQUIRED.items():
        for name, kind in fields.items():
            mine, there = F.col("event") == event, _json_type(name).isNotNull()
            checks.append(F.when(mine & ~there, F.struct(F.lit("required").alias("rule"), F.lit(name).alias("detail"))))
            checks.append(F.when(mine & there & ~_has_type(name, kind), F.struct(F.lit("type").alias("rule"), F.lit(name).alias("detail"))))
    for (event, name), allowed in ENUMS.items():
        checks.append(F.when((F.col("event") == event) & ~field(name).isin(*allowed), F.struct(F.lit("enum").alias("rule"), F.lit(name).alias("detail"))))
    failure = F.col("event") == "failure"
    if severities:
        checks.append(F.when(failure & ~field("severity").isin(*severities), F.struct(F.lit("severity").alias("rule"), field("severity").alias("detail"))))
    if resolutions:
        checks.append(F.when(failure & ~field("resolution").isin(*resolutions), F.struct(F.lit("resolution").alias("rule"), field("resolution").alias("detail"))))
    fix = failure & (field("resolution") == "harness_fix") & (F.coalesce(field("harness_ref"), F.lit("")) == "")
    checks.append(F.when(fix, F.struct(F.lit("harness_ref").alias("rule"), F.lit("").alias("detail"))))
    broken = known.select("file", "line", F.explode(F.array_compact(F.array(*checks))).alias("e")).select("file", "line", "e.rule", "e.detail")
    out = bad.union(envelope).union(unknown).union(broken)
    if codes is not None:
        used = known.where(failure).select("file", "line", field("code").alias("code")).where("code is not null")
        out = out.union(used.join(F.broadcast(codes), "code", "left_anti").select("file", "line", F.lit("code"), "code"))
    return out


def corrections(records: DataFrame) -> DataFrame:
    """(file, line, target, verdict) of every correction: voids, or why it does not.

    It must name an earlier line of the file that holds a record, is no
    correction, and was not voided by an earlier correction.
    """
    good = records.where("not bad")
    # A number that is a JSON integer, as read_log parsed it.
    asked = good.where("event = 'correction'").select("file", "line", F.when(_json_type("supersedes") == "BIGINT", field("supersedes", "int")).alias("target"))
    there = good.select(F.col("file").alias("f"), F.col("line").alias("at"), F.col("event").alias("what"))
    met = asked.join(there, (F.col("f") == F.col("file")) & (F.col("at") == F.col("target")) & (F.col("at") < F.col("line")), "left")
    bare = F.when(F.col("at").isNull(), "no_record").when(F.coalesce("what", F.lit("")) == "correction", "is_correction").otherwise("voids")
    first = F.row_number().over(Window.partitionBy("file", "target", "bare").orderBy("line"))
    rows = met.withColumn("bare", bare).withColumn("nth", first)
    return rows.select("file", "line", "target", "what", F.when((F.col("bare") == "voids") & (F.col("nth") > 1), "again").otherwise(F.col("bare")).alias("verdict"))


def effective(records: DataFrame) -> DataFrame:
    """Records that are no corrections and that none voids."""
    gone = corrections(records).where("verdict = 'voids'").select("file", F.col("target").alias("line"))
    return records.where("not bad and coalesce(event, '') != 'correction'").join(gone, ["file", "line"], "left_anti")


def voided_counts(records: DataFrame) -> DataFrame:
    """(file, event, n): how many records of each event corrections point at, valid or not."""
    good = records.where("not bad")
    asked = good.where("event = 'correction'").select("file", F.when(_json_type("supersedes") == "BIGINT", field("supersedes", "int")).alias("line"))
    return asked.join(good.select("file", "line", "event"), ["file", "line"]).where("event is not null").groupBy("file", "event").agg(F.count(F.lit(1)).alias("n"))


def file_errors(records: DataFrame) -> DataFrame:
    """(file, line, rule): what the files break as wholes; line 0 stands for the file."""
    good, live = records.where("not bad"), effective(records)
    name = F.regexp_replace("file", r"\.jsonl$", "")
    row = lambda df, rule, line=F.lit(0): df.select("file", line.cast("int").alias("line"), F.lit(rule).alias("rule"))
    named = row(good.where(F.col("loop_id").isNotNull() & (F.col("loop_id") != "") & (F.col("loop_id") != name)), "loop_id", F.col("line"))
    by = Window.partitionBy("file").orderBy("line")
    ordered = row(good.withColumn("before", F.lag(F.coalesce("ts", F.lit(""))).over(by)).where(F.coalesce("ts", F.lit("")) < F.col("before")).select("file").distinct(), "time_order")
    part = F.split("v", r"\.")
    strict = (F.try_element_at(part, F.lit(1)).try_cast("int") > STRICT_FROM[0]) | ((F.try_element_at(part, F.lit(1)).try_cast("int") == STRICT_FROM[0]) & (F.coalesce(F.try_element_at(part, F.lit(2)).try_cast("int"), F.lit(0)) >= STRICT_FROM[1]))
    owned = live.where("project is not null").withColumn("strict", F.coalesce(strict, F.lit(False)))
    polluted = row(owned.where((F.col("project") == F.col("loop_id")) & F.col("strict")), "project_is_loop", F.col("line"))
    mixed = row(owned.groupBy("file").agg(F.countDistinct("project").alias("n"), F.bool_or("strict").alias("s")).where("n > 1 and s"), "projects_mixed")
    first = row(live.withColumn("nth", F.row_number().over(by)).where("nth = 1 and coalesce(event, '') != 'loop_start'"), "first_is_start")
    ends = live.where("event = 'loop_end'").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("end"))
    twice = row(ends.where("n > 1"), "one_end")
    after = live.join(ends.select("file", "end"), "file").where("line > end").withColumn("nth", F.row_number().over(Window.partitionBy("file", "event").orderBy("line")))
    spent = after.join(voided_counts(records), ["file", "event"], "left").where("nth > coalesce(n, 0)")
    trailing = row(spent.select("file").distinct(), "after_end")
    failures = live.groupBy("file").agg(F.count_if(F.col("event") == "failure").alias("actual"))
    declared = live.where("event = 'loop_end'").join(ends.select("file", F.col("end").alias("line")), ["file", "line"]).select("file", field("failure_count", "int").alias("declared"))
    counted = row(declared.join(failures, "file").where("declared is not null and declared != actual"), "failure_count")
    fixes = row(corrections(records).where("verdict != 'voids'"), "correction", F.col("line"))
    out = named
    for more in (ordered, polluted, mixed, first, twice, trailing, counted, fixes):
        out = out.union(more)
    return out


def fact_loops(live: DataFrame) -> DataFrame:
    """One row per project and loop: start and end facts, counts, the last test run."""
    last = lambda when, what: F.max_by(what, F.when(when, F.struct("file", "line")))
    is_ = lambda e: F.col("event") == e
    start, end, test = is_("loop_start"), is_("loop_end"), is_("test_run")
    return live.groupBy("project", "loop_id").agg(
        last(start, F.col("ts")).alias("started_at"), last(end, F.col("ts")).alias("ended_at"), last(start, field("goal")).alias("goal"),
        last(start, field("scaffold_version")).alias("scaffold_version"), last(start, field("agent")).alias("agent"), last(end, field("outcome")).alias("outcome"),
        F.count_if(is_("failure")).alias("n_failures"), F.count_if(is_("commit")).alias("n_commits"), F.count_if(test).alias("n_test_runs"),
        last(test, field("passed", "int")).alias("last_tests_passed"), last(test, field("failed", "int")).alias("last_tests_failed"),
    )


def fact_failures(live: DataFrame) -> DataFrame:
    cols = [field(c, "int" if c.endswith("stage") else "string").alias(c) for c in ("code", "severity", "detected_stage", "introduced_stage", "summary", "resolution", "harness_ref")]
    return live.where("event = 'failure'").select("ts", "project", "loop_id", *cols)


def two_strike(failures: DataFrame) -> DataFrame:
    """(code, total, needs_hc, has_hc_ref): codes that came up twice or more need a fix of their own."""
    ref = F.bool_or(F.coalesce("harness_ref", F.lit("")) != "")
    return failures.groupBy("code").agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) >= 2).alias("needs_hc"), ref.alias("has_hc_ref"))


def running_failures(failures: DataFrame) -> DataFrame:
    """Failures with how often their code has come up so far, in order of time."""
    by = Window.partitionBy("code").orderBy("ts", "loop_id").rowsBetween(Window.unboundedPreceding, 0)
    return failures.withColumn("so_far", F.count(F.lit(1)).over(by))


def flatten(records: DataFrame, fields: list[str]) -> DataFrame:
    """The envelope and data_<field> columns, nested values as JSON text."""
    value = lambda c: F.try_variant_get(F.try_parse_json("data"), f"$.{c}", "string").alias(f"data_{c}")
    return records.select("v", "ts", "project", "loop_id", "event", *[value(c) for c in fields])


def append(records: DataFrame, new: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """(what to write, errors): new records of a file go behind its last line only if all of them, in place, break nothing."""
    both = records.unionByName(new)
    broken = record_errors(both, **rules).select("file", "line", "rule").union(file_errors(both)).join(new.select("file").distinct(), "file", "left_semi")
    return new.join(broken.select("file").distinct(), "file", "left_anti"), broken


def loop_summary(live: DataFrame) -> DataFrame:
    """One row per file: its first start and end, its last test run, and counts; an outcome of null is a loop in progress."""
    first = lambda when, what: F.min_by(what, F.when(when, F.col("line")))
    is_ = lambda e: F.col("event") == e
    start, end, test = is_("loop_start"), is_("loop_end"), is_("test_run")
    last = lambda what: F.max_by(what, F.when(test, F.col("line")))
    return live.groupBy("file").agg(
        first(start, F.col("project")).alias("project"), first(start, field("goal")).alias("goal"), first(start, field("spec_refs")).alias("spec_refs"),
        first(start, field("scaffold_version")).alias("scaffold_version"), first(end, field("outcome")).alias("outcome"), first(end, field("summary")).alias("summary"),
        F.count_if(test).alias("n_test_runs"), last(field("passed", "int")).alias("passed"), last(field("failed", "int")).alias("failed"),
        F.count_if(is_("commit")).alias("n_commits"), F.count_if(is_("failure")).alias("n_failures"),
    )


def failure_lines(live: DataFrame, codes: DataFrame) -> DataFrame:
    """(file, line, severity, code, name, summary, resolution, harness_ref): a summary's failures, named by `codes` (code, name), else ?."""
    cols = [field(c).alias(c) for c in ("severity", "code", "summary", "resolution", "harness_ref")]
    rows = live.where("event = 'failure'").select("file", "line", *cols)
    return rows.join(codes.select("code", "name"), "code", "left").select("file", "line", "severity", "code", F.coalesce("name", F.lit("?")).alias("name"), "summary", "resolution", "harness_ref")
