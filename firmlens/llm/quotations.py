"""Quotation linking: quoted passages are traced to their messages, threads are rebuilt without quotes.

Lines that begin with ``>`` marks are quotes of that level. Runs of one level are passages. Passages
and the unquoted text of every message are normalised (lower case, single spaces) and hashed as a
whole, by blocks between blank lines, and by lines. A quoted unit is linked to the earliest message
of the conversation, before the quoting one, whose own text holds the same unit; failing that, to the
earliest message of any other conversation. A message replies to the one in its conversation from
which its first-level quotes take most characters (ties: the latest). Threads are followed to their
root by pointer doubling, and each conversation is numbered thread by thread in order of turns.

Messages that hold a unit are reduced to the earliest per conversation, and per unit to those of the
two smallest conversations, before any join, so a phrase that everybody uses is one row and no pairs arise. Null texts are empty. Units of any
length with a letter or digit are linked, within the conversation first, else to the smallest other conversation that holds them; a floor for the latter can
be set (``min_chars``). Repeated rows (same conversation, turn and text) give repeated
results; messages without conversation or turn have no links. Other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmlens.llm.registry import query, table
from firmlens.llm.scratch import stored
from firmlens.operators.ordered import row_numbers

#: Characters from which a unit is sought in other conversations, and a part beside its linked whole; 1 loses no link.
MIN_CHARS = 1
MARKS = r"^(?:[ \t]*>)+"
#: Lines that announce a quotation and belong to it.
ANNOUNCES = r"(?i)^(?:on|am|le|el) .*(?:wrote|schrieb|écrit|escribió) ?:[ \t]*$"


def unquoted(text: Column) -> Column:
    """The message's own lines: no quotes, no announcing lines, no blank lines at the ends."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: ~line.rlike(MARKS) & ~line.rlike(ANNOUNCES))
    return F.when(F.contains(text, F.lit(">")), F.regexp_replace(F.array_join(own, "\n"), r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "")).otherwise(F.coalesce(text, F.lit("")))


def units(text: Column) -> Column:
    """Normalised whole, blocks and lines of a passage, each once, the whole first."""
    pieces = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n"))
    return F.filter(F.array_distinct(F.transform(pieces, lambda p: F.trim(F.regexp_replace(F.lower(p), r"\s+", " ")))), lambda p: p.rlike(r"[\p{L}\p{N}]"))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, n, level, passage): runs of lines of one quote level, marks removed."""
    quoting = messages.filter(F.col("text").rlike(r"(?m)" + MARKS)).select("conv_id", "turn", "text").dropDuplicates()
    line = F.col("line")
    marks = F.regexp_extract(line, MARKS, 0)
    lines = quoting.select("conv_id", "turn", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "conv_id", "turn", "h", "pos", F.regexp_replace(line, MARKS + " ?", "").alias("body"), F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"))
    along = Window.partitionBy("conv_id", "turn", "h").orderBy("pos")
    runs = lines.withColumn("run", F.sum(F.when(F.col("level") == F.lag("level").over(along), 0).otherwise(1)).over(along)).filter("level > 0")
    return runs.groupBy("conv_id", "turn", "h", "run", "level").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n").alias("passage")).select(
        "conv_id", "turn", F.col("run").alias("n"), "level", "passage")


def links(messages: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(conv_id, turn, n, level, unit, chars, from_conv, from_turn): every quoted unit with its origin."""
    told = messages.filter("conv_id is not null and turn is not null")
    own = stored(told.select("conv_id", "turn", F.explode(units(unquoted(F.col("text")))).alias("u")).select(
        "conv_id", "turn", F.xxhash64("u").alias("unit"), (F.length("u") >= min_chars).alias("long")), "units")
    here = stored(own.groupBy("conv_id", "unit").agg(F.min("turn").alias("first_turn"), F.max("long").alias("long")), "here")
    # the two smallest conversations of a unit (kept before the shuffle): one of them is not the quoting one
    holder = F.struct("conv_id", "first_turn")
    two = here.filter("long").withColumn("place", F.row_number().over(Window.partitionBy("unit").orderBy("conv_id"))).filter("place <= 2")
    anywhere = stored(two.groupBy("unit").agg(F.min(holder).alias("one"), F.max(holder).alias("two")), "anywhere")
    quoted = stored(quoted_passages(told).select("conv_id", "turn", "n", "level", F.xxhash64("passage").alias("h"), F.posexplode(units(F.col("passage"))).alias("pos", "u")).select(
        "conv_id", "turn", "n", "level", "h", "pos", F.xxhash64("u").alias("unit"), F.length("u").alias("chars")), "quoted")
    inside = (F.col("first_turn") < F.col("turn"))
    other = F.when(F.col("one.conv_id") != F.col("conv_id"), F.col("one")).when(F.col("two.conv_id") != F.col("conv_id"), F.col("two"))
    whole = F.max((F.col("pos") == 0) & (F.col("from_conv") == F.col("conv_id"))).over(Window.partitionBy("conv_id", "turn", "n", "h"))
    return (quoted.join(here.drop("long"), ["conv_id", "unit"], "left").join(anywhere, "unit", "left")
            .withColumn("from_conv", F.when(inside, F.col("conv_id")).otherwise(other["conv_id"]))
            .withColumn("from_turn", F.when(inside, F.col("first_turn")).otherwise(other["first_turn"]))
            .filter("from_conv is not null").withColumn("whole", whole).filter((F.col("pos") == 0) | (F.col("chars") >= min_chars) | ~F.col("whole")).select("conv_id", "turn", "n", "level", "unit", "chars", "from_conv", "from_turn"))


def thread_roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, thread_turn, depth) for messages with a parent (conv_id, turn, parent_turn).

    Each round doubles the distance that a message looks up, so it takes log2 of the deepest thread.
    """
    seen = stored(parents.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("thread_turn"), F.lit(1).cast("bigint").alias("depth")), "roots")
    while True:
        above = seen.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("next_turn"), F.col("depth").alias("more"))
        raised = seen.join(above, ["conv_id", "thread_turn"], "left")
        if raised.filter("next_turn is not null").isEmpty():
            return seen
        seen = stored(raised.select("conv_id", "turn", "parent_turn", F.coalesce("next_turn", "thread_turn").alias("thread_turn"),
                                    (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "roots")


def conversations(messages: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Messages without quotes, with parent, thread, depth, link counts and their place in reply order."""
    found = stored(links(messages, min_chars), "links")
    counts = found.groupBy("conv_id", "turn").agg(F.count_distinct("n").alias("n_linked_passages"), F.count_distinct("from_conv", "from_turn").alias("n_sources"))
    taken = found.filter("level = 1 and from_conv = conv_id").groupBy("conv_id", "turn", "from_turn").agg(F.sum("chars").alias("chars"))
    parents = taken.groupBy("conv_id", "turn").agg(F.max(F.struct("chars", "from_turn")).alias("best")).select("conv_id", "turn", F.col("best.from_turn").alias("parent_turn"))
    known = stored(counts.join(thread_roots(parents), ["conv_id", "turn"], "left"), "threads")
    placed = messages.select("conv_id", "turn", "role", "text").join(known, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
        F.coalesce("n_linked_passages", F.lit(0)).cast("bigint").alias("n_linked_passages"), F.coalesce("n_sources", F.lit(0)).cast("bigint").alias("n_sources"),
        unquoted(F.col("text")).alias("text"))
    levels = {"__a": F.floor(F.col("thread_turn") / 64), "__b": F.floor(F.col("turn") / 64)}
    ranked = row_numbers(placed.withColumns(levels), ["conv_id"], [["__a"], ["thread_turn"], ["__b"]], ["turn", "role", "text"], "reply_rank")
    return ranked.drop(*levels)


_UNITS = r"list_filter(list_distinct(list_transform(list_concat([{0}], regexp_split_to_array({0}, '\n[ \t]*\n'), string_split({0}, chr(10))), lambda p: trim(regexp_replace(lower(p), '\s+', ' ', 'g')))), lambda p: regexp_matches(p, '[\p{{L}}\p{{N}}]'))"
_OWN = r"""CASE WHEN contains(text, '>') THEN regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^(?:[ \t]*>)+')
  AND NOT regexp_matches(l, '(?i)^(?:on|am|le|el) .*(?:wrote|schrieb|écrit|escribió) ?:[ \t]*$')), chr(10)), '^(?:[ \t]*\n)+|(?:\n[ \t]*)+$', '', 'g') ELSE coalesce(text, '') END"""
SQL = rf"""
WITH RECURSIVE own AS (SELECT DISTINCT conv_id, turn, unnest({_UNITS.format('o')}) AS u FROM (SELECT conv_id, turn, {_OWN} AS o FROM conversations)),
lines AS (SELECT conv_id, turn, pos, regexp_replace(line, '^(?:[ \t]*>)+ ?', '') AS body, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM (SELECT DISTINCT conv_id, turn, text FROM conversations))),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY pos) AS run FROM lines),
passages AS (SELECT conv_id, turn, level, run, string_agg(body, chr(10) ORDER BY pos) AS passage FROM runs WHERE level > 0 GROUP BY ALL),
quoted AS (SELECT conv_id, turn, level, run, unnest({_UNITS.format('passage')}) AS u FROM passages),
linked AS (SELECT q.*, (SELECT min(turn) FROM own o WHERE o.conv_id = q.conv_id AND o.u = q.u AND o.turn < q.turn) AS here,
  (SELECT min((o.conv_id, o.turn)) FROM own o WHERE o.u = q.u AND o.conv_id <> q.conv_id) AS anywhere FROM quoted q),
found AS (SELECT *, CASE WHEN here IS NOT NULL THEN conv_id ELSE anywhere[1] END AS from_conv, coalesce(here, anywhere[2]) AS from_turn FROM linked
  WHERE here IS NOT NULL OR anywhere IS NOT NULL),
counts AS (SELECT conv_id, turn, count(DISTINCT (level, run)) AS n_linked_passages, count(DISTINCT (from_conv, from_turn)) AS n_sources FROM found GROUP BY ALL),
taken AS (SELECT conv_id, turn, from_turn, sum(length(u)) AS chars FROM found WHERE level = 1 AND here IS NOT NULL GROUP BY ALL),
parents AS (SELECT conv_id, turn, arg_max(from_turn, (chars, from_turn)) AS parent_turn FROM taken GROUP BY ALL),
up AS (SELECT conv_id, turn, parent_turn AS above, 1 AS depth FROM parents UNION ALL SELECT up.conv_id, up.turn, p.parent_turn, depth + 1 FROM up JOIN parents p ON p.conv_id = up.conv_id AND p.turn = up.above),
roots AS (SELECT conv_id, turn, arg_max(above, depth) AS thread_turn, max(depth) AS depth FROM up GROUP BY ALL),
placed AS (SELECT c.conv_id, c.turn, c.role, parent_turn, coalesce(thread_turn, c.turn) AS thread_turn, coalesce(depth, 0)::BIGINT AS depth,
  coalesce(n_linked_passages, 0)::BIGINT AS n_linked_passages, coalesce(n_sources, 0)::BIGINT AS n_sources, {_OWN} AS text
  FROM conversations c LEFT JOIN parents USING (conv_id, turn) LEFT JOIN roots USING (conv_id, turn) LEFT JOIN counts USING (conv_id, turn))
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn, turn, role, text) AS reply_rank FROM placed"""


@query("op1_quotation_threads", sql=SQL)
def op1_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))
