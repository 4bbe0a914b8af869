"""Quotation linking: messages find what they quote, and conversations come out in reply order without quotes.

DataFrame functions only. Lines are parsed into quote levels by their marks ("> > text" is level 2), normalised
(case, white space) and hashed. A quoted line links to the latest earlier message of its thread that wrote that line
itself. The shallowest level names the message replied to; deeper levels name its ancestors. The replies to a root are
a tree; a tour around it numbers its messages so that each follows what it answers.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from riskloom.llm.common import at_rest, spare, table

#: Positions of a thread that one window may hold for one passage.
BLOCK_BITS = 10


def parsed(text: Column) -> Column:
    """(level, body) of each line of a message; null has none. Marks may stand close or apart: ">>", "> >"."""
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, r"^((?:>[ \t]?)*+)", 1)  # possessive: Java's matcher does not recurse
        return F.struct(F.length(F.regexp_replace(marks, r"[^>]", "")).alias("level"),
                        F.substring(x, F.length(marks) + 1, F.length(x)).alias("body"))

    return F.transform(F.split(text, r"\r?\n"), line)


def normalised(body: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(body, r"[\s ]+", " ")))


def unquoted(lines: Column) -> Column:
    """The lines that are the message's own."""
    return F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")


def quoted_links(lines: DataFrame) -> DataFrame:
    """(thread, position, level, target, n): how many quoted lines of a level link to which earlier message.

    For each passage the message before is found by a window over blocks of positions, and by another one over the
    blocks' last messages; so a passage that a third of all messages hold is spread over its blocks, and no pairs of
    messages are made.
    """
    said = lines.select("thread", "position", F.col("line.level").alias("level"),
                        normalised(F.col("line.body")).alias("body")).filter("body <> ''")
    said = said.groupBy("thread", "position", "level", F.xxhash64("body").alias("h")).agg(
        F.count(F.lit(1)).alias("n"))
    said = at_rest(said, "said").withColumns({"block": F.shiftright("position", BLOCK_BITS),
                             "own": F.when(F.col("level") == 0, F.col("position"))})
    key = ["thread", "h"]
    # A message's own line comes after its quotes of the same line: it cannot answer itself.
    inside = W.partitionBy(*key, "block").orderBy("position", F.col("level").desc()).rowsBetween(
        W.unboundedPreceding, -1)
    before = W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = said.groupBy(*key, "block").agg(F.max("own").alias("last")).select(
        *key, "block", F.max("last").over(before).alias("carried"))
    found = said.withColumn("near", F.max("own").over(inside)).filter("level > 0").join(blocks, [*key, "block"])
    return (found.withColumn("target", F.coalesce("near", "carried")).filter("target is not null")
            .groupBy("thread", "position", "level", "target").agg(F.sum("n").alias("n")))


def tour(parents: DataFrame) -> DataFrame:
    """The steps of a tour around every reply tree, from (thread, position, reply_to): each message is entered and left.

    (thread, position, side: 0 enters, 1 leaves; before_position, before_side: the step before, null for the first).
    The step before entering a message is leaving its elder sibling, or entering what it answers; before leaving it,
    leaving its youngest reply, or entering it. Elder siblings come from a window over blocks of positions and one
    over the blocks, so that a message with very many replies is cut.
    """
    replies = parents.filter("reply_to is not null").withColumn("block", F.shiftright("position", BLOCK_BITS))
    key = ["thread", "reply_to"]
    blocks = replies.groupBy(*key, "block").agg(F.max("position").alias("last")).select(
        *key, "block", F.lag("last").over(W.partitionBy(*key).orderBy("block")).alias("carried"))
    inside = W.partitionBy(*key, "block").orderBy("position")
    elder = replies.withColumn("near", F.lag("position").over(inside)).join(blocks, [*key, "block"]).select(
        "thread", "position", "reply_to", F.coalesce("near", "carried").alias("elder"))
    youngest = replies.groupBy("thread", F.col("reply_to").alias("position")).agg(F.max("position").alias("youngest"))
    both = parents.select("thread", "position").join(elder, ["thread", "position"], "left").join(
        youngest, ["thread", "position"], "left")
    steps = F.array(
        F.struct(F.lit(0).alias("side"), F.coalesce("elder", "reply_to").alias("before_position"),
                 F.when(F.col("elder").isNotNull(), 1).when(F.col("reply_to").isNotNull(), 0).alias("before_side")),
        F.struct(F.lit(1).alias("side"), F.coalesce("youngest", "position").alias("before_position"),
                 F.when(F.col("youngest").isNotNull(), 1).otherwise(0).alias("before_side")))
    return both.select("thread", "position", F.inline(steps))


def rooted(parents: DataFrame) -> DataFrame:
    """(thread, position, root, depth, place) of every message from (thread, position, reply_to).

    Steps of the tour are ranked by pointer doubling: a step knows how many messages were entered, and how many of
    them not left, since the step it points to. A reply's target is earlier, so there are no cycles; the rounds grow
    with the logarithm of the largest tree. A step that points to a known one is done: a round joins only those that
    are not, so large trees cost small ones nothing.
    """
    first = F.col("before_position").isNull()
    start = at_rest(tour(parents).select(
        "thread", "position", "side", "before_position", "before_side", F.when(first, F.col("position")).alias("root"),
        (1 - F.col("side")).cast("long").alias("entered"), (1 - 2 * F.col("side")).cast("long").alias("depth")), "tour")
    done, left = start.filter("root is not null"), start.filter("root is null")
    while not left.isEmpty():
        above = done.unionAll(left).select("thread", F.col("position").alias("before_position"),
                                           F.col("side").alias("before_side"), F.struct(
            "before_position", "before_side", "root", "entered", "depth").alias("above"))
        state = at_rest(left.join(above, ["thread", "before_position", "before_side"]).select(
            "thread", "position", "side", "above.before_position", "above.before_side", "above.root",
            (F.col("entered") + F.col("above.entered")).alias("entered"),
            (F.col("depth") + F.col("above.depth")).alias("depth")), "steps")
        done = done.unionAll(state.filter("root is not null"))
        left = state.filter("root is null")
    return done.filter("side = 0").select("thread", "position", "root", (F.col("depth") - 1).alias("depth"),
                                          (F.col("entered") - 1).alias("place"))


def reply_ordered(messages: DataFrame, thread: str = "conv_id", position: str = "turn",
                  text: str = "text") -> DataFrame:
    """messages with `reply_to`, `quotes` (level, target), `thread_root`, `depth`, `place` and `body` (without quotes).

    Sorted by thread, thread_root and place, the rows are the conversations in reply order: a root has place 0, and
    each message follows what it answers and all that came of earlier answers to that (depth first, siblings by
    position). Positions are whole numbers that ascend in time. Messages that quote nothing known are roots: reply_to
    is null, thread_root their own position, depth and place 0; so are all with a null thread or position. A null text
    has a null body; a table without rows gives none. Rows that
    repeat a thread and position are one message for linking (their lines are taken together) and stay rows. A line
    that several messages wrote counts for the latest; on a tie of lines the later message is the one replied to.
    Columns of messages that have the names of the new ones are replaced; all others stay.
    """
    new = ("reply_to", "quotes", "thread_root", "depth", "place", "body")
    messages = messages.drop(*[c for c in messages.columns if c.lower() in new])
    split, in_thread, at, root, depth, place = (
        spare(c, [*messages.columns, *new]) for c in ("_lines", "_t", "_p", "_root", "_depth", "_place"))
    rows = messages.withColumn(split, parsed(F.col(text)))
    lines = rows.select(F.col(thread).alias("thread"), F.col(position).cast("long").alias("position"),
                        F.explode(split).alias("line")).filter("thread is not null and position is not null")
    links = at_rest(quoted_links(lines), "quotes")
    replies = links.groupBy("thread", "position").agg(
        F.max(F.struct((-F.col("level")).alias("level"), "n", "target"))["target"].alias("reply_to"),
        # As many as the message has quote levels and targets.
        F.array_sort(F.collect_list(F.struct("level", "target"))).alias("quotes"))
    known = messages.select(F.col(thread).alias("thread"), F.col(position).cast("long").alias("position")).dropna()
    parents = known.distinct().join(replies, ["thread", "position"], "left")
    parents = at_rest(parents, "replies")
    placed = rooted(parents).join(parents, ["thread", "position"])
    placed = placed.select(F.col("thread").alias(in_thread), F.col("position").alias(at), "reply_to", "quotes",
                           F.col("root").alias(root), F.col("depth").alias(depth), F.col("place").alias(place))
    joined = rows.join(placed, (F.col(thread) == F.col(in_thread)) & (F.col(position).cast("long") == F.col(at)), "left")
    return joined.withColumns({
        "thread_root": F.coalesce(root, F.col(position).cast("long")),
        "depth": F.coalesce(depth, F.lit(0).cast("long")),
        "place": F.coalesce(place, F.lit(0).cast("long")),
        "body": unquoted(F.col(split))}).drop(split, in_thread, at, root, depth, place)


def quoting(messages: DataFrame) -> DataFrame:
    """The turns of conversations as mails: each quotes the turn before, and that one's quote of the turn before it."""
    said = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))

    def earlier(by: int) -> DataFrame:
        return said.select("conv_id", (F.col("turn") + by).alias("turn"), F.col("said").alias(f"said{by}"))

    def marked(c: str, mark: str) -> Column:
        return F.concat(F.lit(mark), F.regexp_replace(c, "\n", "\n" + mark))

    joined = messages.join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left")
    return joined.withColumn("text", F.concat_ws(
        "\n", marked("said1", "> "), marked("said2", "> > "), "text")).drop("said1", "said2")


def op3_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations hold no quotes, so they are first written as mails that quote the turns before."""
    found = reply_ordered(quoting(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "turn", "role", "reply_to", "thread_root", "depth", "place",
                        F.array_join(F.transform("quotes", lambda q: F.concat_ws(
                            ":", q["level"].cast("string"), q["target"].cast("string"))), ",").alias("quotes"), "body")


def op3_sql() -> str:
    norm = r"lower(trim(regexp_replace(x, '[\s\x{A0}]+', ' ', 'g')))"
    return rf"""
with recursive l as (
  select conv_id, turn, unnest(string_split(text, chr(10))) as x from conversations),
own as (select distinct conv_id, turn, {norm} as x from l where {norm} <> ''),
q as (select conv_id, turn + d as turn, d as level, x, count(*) as n
      from (select conv_id, turn, {norm} as x from l) s, (values (1), (2)) v(d)
      where x <> '' and exists (select 1 from conversations c where c.conv_id = s.conv_id and c.turn = s.turn + d)
      group by all),
t as (select conv_id, turn, level, target, sum(n) as n
      from (select q.conv_id, q.turn, level, q.x, any_value(n) as n, max(own.turn) as target
            from q join own on own.conv_id = q.conv_id and own.x = q.x and own.turn < q.turn group by 1, 2, 3, 4)
      group by 1, 2, 3, 4),
r as (select conv_id, turn, arg_max(target, -level * 1000000000 + n * 1000 + target) as reply_to,
      string_agg(level || ':' || target, ',' order by level, target) as quotes from t group by 1, 2),
walk as (select c.conv_id, c.turn, c.turn as root, 0 as depth, [c.turn] as path from conversations c
         left join r using (conv_id, turn) where reply_to is null
         union all
         select r.conv_id, r.turn, w.root, w.depth + 1, list_append(w.path, r.turn) from r join walk w on w.conv_id = r.conv_id
         and w.turn = r.reply_to)
select c.conv_id, c.turn, role, reply_to, root as thread_root, cast(depth as bigint) as depth,
  row_number() over (partition by c.conv_id, root order by path) - 1 as place, quotes, text as body
from conversations c left join r using (conv_id, turn) join walk using (conv_id, turn)"""
