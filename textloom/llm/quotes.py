"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels. Runs of quoted lines of one
level, and each of their lines, are normalised and hashed, and joined to the
messages of the same conversation that said them first. A message replies to
the message that its outermost linked quotation comes from. What it says itself
is kept, without quotations and the lines that introduce them, and messages are
ordered by thread, depth first: a thread stands where its first message does, and
each message is followed by its replies, in turn, and theirs. Conversations are
built as arrays of messages in that order, in parts of bounded length.

Originals are summed up to one row per passage and conversation before they are
joined, places in a thread come from doubling the steps up the tree, and places in
a conversation from a range sort, so neither a hot passage nor a hot conversation
meets in one task. Texts move once, to their places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ROW, TMP, global_rank, store, told_apart
from textloom.operators.ranking import running_total

#: Messages of a part of a conversation, at most.
PART = 256

_MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$", re.S)
#: A line that introduces a quotation.
_INTRO = re.compile(r"^\s*(?:On\b.{0,200}\bwrote|.{1,80}\bschrieb\b.{0,100}|Le\b.{0,200}\ba écrit|El\b.{0,200}\bescribió)\s*:\s*$")
_SPACE = re.compile(r"\s+")


def normal(passage: str) -> str:
    """Case, white space and closing marks do not tell quotations apart."""
    return _SPACE.sub(" ", passage).strip().strip(".!?… ").casefold()


def key(passage: str) -> int | None:
    """The hash of a normalised passage as a signed integer; none if nothing is left of it."""
    text = normal(passage)
    if not text:
        return None
    h = xxhash.xxh64_intdigest(text.encode())
    return h - (1 << 64) if h >> 63 else h


def parse(text: str | None) -> tuple[str | None, list[tuple[int, str]]]:
    """What a message says itself, and its quoted runs as (level, passage)."""
    if text is None:
        return None, []
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        m = _MARK.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            if not before and own and _INTRO.match(own[-1]):
                own.pop()
            body = m[2]
            if not body.strip():
                if runs and before == level:
                    runs.append((level, []))  # a quoted blank line ends the passage
            elif runs and before == level:
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
        before = level
    said = "\n".join(own)
    return (said.strip("\n") if runs else said), [(lv, "\n".join(x)) for lv, x in runs if x]


def passages(own: str | None) -> set[int]:
    """The keys by which a message's own words may be quoted: all of them, its paragraphs, its lines."""
    if not own:
        return set()
    parts = [own, *re.split(r"\n\s*\n", own), *own.split("\n")]
    return {k for p in parts if (k := key(p)) is not None}


def own_words(text: Column) -> Column:
    """What each message says itself."""
    return F.arrow_udf(lambda texts: pa.array([parse(t.as_py())[0] for t in texts], pa.string()), "string")(text)


def read(messages: DataFrame) -> DataFrame:
    """ROW, conv_id, turn, role, mark (of role and text), said (keys) and quoted (level, run, key) of every message."""
    kind = pa.list_(pa.struct([("level", pa.int32()), ("run", pa.int32()), ("key", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, quoted = [], []
            for text in batch.column(batch.num_columns - 1):
                mine, runs = parse(text.as_py())
                said.append(sorted(passages(mine)))
                found = [(lv, n, k) for n, (lv, x) in enumerate(runs) for k in dict.fromkeys(map(key, [x, *x.split("\n")])) if k is not None]
                quoted.append([{"level": lv, "run": n, "key": k} for lv, n, k in found])
            names = [*batch.schema.names[:-1], "said", "quoted"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(said, pa.list_(pa.int64())), pa.array(quoted, kind)], names=names)

    rows = messages.select(ROW, "conv_id", "turn", "role", F.xxhash64("text").alias("mark"), "text")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, fields + "said array<long>, quoted array<struct<level:int,run:int,key:long>>")


def _at(a: str, b: str, turn: str) -> Column:
    """Rows of `a` whose `turn` is the turn of `b`, in one conversation."""
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.{turn}") == F.col(f"{b}.turn"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root, place) of every reply (conv_id, turn, reply_to): where its thread begins, and its place there, depth first.

    The steps up are doubled, so a chain of any length takes a few rounds: a first
    time for the roots and the sizes of subtrees, a second time to add up, over a
    message's ancestors, what stands before each among its siblings.
    """
    state = store(replies.select("conv_id", "turn", F.col("reply_to").alias("parent"), F.col("reply_to").alias("top"), F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("size")), "replies")
    while state.where("up is not null").limit(1).count():
        gained = store(state.where("up is not null").groupBy("conv_id", F.col("up").alias("turn")).agg(F.sum("size").alias("more")), "gained")
        joined = state.alias("a").join(state.select("conv_id", "turn", "top", "up").alias("b"), _at("a", "b", "top"), "left").join(gained.alias("g"), _at("a", "g", "turn"), "left")
        up = F.when(F.col("a.up").isNotNull(), F.col("b.up"))
        state = store(joined.select("a.conv_id", "a.turn", "a.parent", F.coalesce("b.top", "a.top").alias("top"), up.alias("up"), (F.col("a.size") + F.coalesce("g.more", F.lit(0))).alias("size")), "replies")
    before = store(running_total(state.select("conv_id", "turn", "parent", "top", "size"), ["conv_id", "parent", "turn"], F.col("size"), "before"), "before")
    firsts = store(before.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("before").alias("least")), "firsts")
    steps = before.alias("a").join(firsts.alias("b"), _at("a", "b", "parent"))
    steps = store(steps.select("a.conv_id", "a.turn", F.col("a.top").alias("root"), F.col("a.parent").alias("up"), (F.col("a.before") - F.col("b.least") + 1).alias("place")), "steps")
    while True:
        joined = steps.alias("a").join(steps.select("conv_id", "turn", "up", "place").alias("b"), _at("a", "b", "up"), "left")
        new = joined.select("a.conv_id", "a.turn", "a.root", F.coalesce("b.up", "a.up").alias("up"), (F.col("a.place") + F.coalesce("b.place", F.lit(0))).alias("place"), F.col("b.up").isNotNull().alias("moved"))
        new = store(new, "steps")
        steps = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return steps.drop("up")


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", row: Column | None = None) -> DataFrame:
    """Every message: conv_id, turn, role, text, n_quotes, n_linked, reply_to, thread_turn, position.

    `text` is what the message says itself, null for null. `n_quotes` counts its
    quoted runs and `n_linked` those of which a passage was found in an earlier
    turn. `reply_to` is the turn it answers: that of the lowest linked level, the
    latest if there are several; null if none. `thread_turn` is the turn where
    its chain of replies begins, its own if it answers none. `position` counts a
    conversation's messages in reply order, depth first, from 0. Messages of a null
    conversation form one; those of a null turn come first, link to none and are
    linked by none. Repeated rows stay, each with a position. Texts of any length
    are read whole. Other columns are not read. An empty table gives no rows.

    `row` tells the rows of `messages` apart each time they are read, as a file's
    name and place in it do; without it they are stored with numbers first.
    """
    cols = [F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).alias("text")]
    base = told_apart(messages, row, "messages").select(*cols, ROW)
    rows = store(read(base), "keys")
    first = rows.where("turn is not null").select("conv_id", "turn", F.explode("said").alias("key")).groupBy("conv_id", "key").agg(F.min("turn").alias("source"))
    asked = rows.where("turn is not null and size(quoted) > 0").select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.run", "q.key").distinct()
    q, f = asked.alias("q"), first.alias("f")
    met = q.join(f, F.col("q.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("q.key") == F.col("f.key")) & (F.col("f.source") < F.col("q.turn")))
    best = F.max(F.struct(-F.col("q.level"), F.col("f.source")))
    links = store(met.groupBy("q.conv_id", "q.turn").agg(best["source"].alias("reply_to"), F.countDistinct("q.run").alias("n_linked")), "links")
    runs = F.size(F.array_distinct(F.transform("m.quoted", lambda s: s["run"]))).cast("long")
    linked = rows.alias("m").join(links.alias("x"), _at("m", "x", "turn"), "left").join(threads(links).alias("c"), _at("m", "c", "turn"), "left")
    linked = linked.select(
        F.col(f"m.{ROW}").alias(f"{TMP}own"), F.col("m.conv_id").alias("conv_id"), F.col("m.turn").alias("turn"), F.col("m.role").alias("role"), "m.mark", runs.alias("n_quotes"),
        F.coalesce("x.n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("x.reply_to").alias("reply_to"), F.coalesce("c.root", "m.turn").alias("thread_turn"), F.coalesce("c.place", F.lit(0)).alias("place"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "thread_turn", "place", "turn", "role", "mark", f"{TMP}own")]
    placed = store(global_rank(linked, order, "position", within=["conv_id"]).drop("conv_id", "turn", "role"), "placed")
    said = base.withColumn("text", own_words(F.col("text")))
    return said.join(placed, F.col(ROW) == F.col(f"{TMP}own")).select("conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", "thread_turn", "position")


def conversations(linked: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, n_messages, messages) from the rows of `link`: the messages in reply order, `part` of them a row at most.

    A conversation of more messages goes on in its next part, so no row grows with
    a conversation. A null conversation is one of its own. No messages give no rows.
    """
    message = F.struct("position", "turn", "role", "text", "n_quotes", "n_linked", "reply_to", "thread_turn")
    built = linked.groupBy("conv_id", F.floor(F.col("position") / part).alias("part")).agg(F.array_sort(F.collect_list(message)).alias("messages"))
    return built.select("conv_id", "part", F.size("messages").cast("long").alias("n_messages"), "messages")
