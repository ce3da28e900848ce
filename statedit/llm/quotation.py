"""Quotation linking of conversations, in DataFrame operations only.

A line's quote level is the number of leading ``>``. Runs of lines of one level are passages.
Every quoted passage, and each of its lines, is normalised and hashed, and joined to the
earliest message of the conversation whose own text has it as a whole, a paragraph or a line.
A message answers the latest original of its shallowest linked quotes. Conversations are then
put in reply order, thread by thread, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .sharding import number_within

_MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def parse_lines(text: Column) -> Column:
    """Array of (level, line): quote level and the line without its quote marks."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    return F.transform(lines, lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", "")).alias("level"),
        F.regexp_replace(x, _MARKS, "").alias("line")))


def run_starts(lines: str) -> Column:
    """Positions of the lines whose level differs from that of the line before."""
    return F.expr(f"filter(sequence(0, size({lines}) - 1), i -> i = 0 or {lines}[i].level <> {lines}[i - 1].level)")


def passages(lines: str, starts: str) -> Column:
    """Array of (level, text): runs of lines of one level, joined by line breaks. Every line is copied once."""
    return F.expr(f"""transform({starts}, (s, k) -> struct({lines}[s].level as level, array_join(transform(
        slice({lines}, s + 1, coalesce(get({starts}, k + 1), size({lines})) - s), x -> x.line), '\n') as text))""")


def normal(text: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _units(text: Column) -> Column:
    """Distinct hashes of a text as a whole, its paragraphs and its lines; empty ones left out."""
    parts = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n"))
    kept = F.filter(F.transform(parts, normal), lambda x: x != "")
    return F.array_distinct(F.transform(kept, lambda x: F.xxhash64(x)))


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, turn, role, body, quote_levels, parent_turn, root_turn, depth) per message.

    ``body`` is the message without quotes; ``position`` counts from 0 in reply order: by the
    thread's first turn, then by turn, so that an answer follows what it answers. A message
    without a linked quote begins a thread. A quote links to earlier turns of the same
    conversation only. Rows that repeat (conv_id, turn) stay rows of their own and share the
    links; null ids and turns never link and come first. A null text is empty. Quotes of any
    depth and length count in full.
    """
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), parse_lines(F.col(text)).alias("lines"))
    own = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"))
    own = F.regexp_replace(own, r"^\s+|\s+$", "")
    levels = F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0))
    rows = rows.withColumn("starts", F.when(levels > 0, run_starts("lines")))
    parsed = materialize(rows.select(
        "conv_id", "turn", "role", own.alias("body"), levels.alias("quote_levels"),
        F.filter(passages("lines", "starts"), lambda p: p["level"] > 0).alias("quotes")))

    quotes = parsed.where("quote_levels > 0 and conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.inline("quotes").alias("level", "quote")).select(
        "conv_id", "turn", "level", F.explode(_units(F.col("quote"))).alias("unit")).distinct()
    quotes = materialize(quotes)
    # only units that some quote of the conversation has are worth an index entry
    asked = quotes.select("conv_id", "unit").distinct()
    originals = (
        parsed.where("conv_id is not null and turn is not null").join(asked.select("conv_id").distinct(), "conv_id", "left_semi")
        .select("conv_id", "turn", F.explode(_units(F.col("body"))).alias("unit"))
        .groupBy("conv_id", "unit").agg(F.min("turn").alias("origin")))
    hits = quotes.join(originals, ["conv_id", "unit"]).where("origin < turn")
    parents = hits.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("origin")).alias("o"))).alias("p"))
    # ancestors by doubling: (node, ancestor reached so far, steps) until no ancestor has a parent
    reach = materialize(parents.select("conv_id", "turn", (-F.col("p.o")).alias("parent_turn")))
    reach = reach.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = reach.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"), F.col("depth").alias("more"))
        joined = materialize(reach.join(up, ["conv_id", "root_turn"], "left"))
        if joined.where("above is not null").isEmpty():
            break
        reach = joined.select("conv_id", "turn", "parent_turn", F.coalesce("above", "root_turn").alias("root_turn"),
                              (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    done = parsed.drop("quotes").join(reach, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", "quote_levels", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    return number_within(done, "conv_id", "root_turn", "turn", "role", "body", name="position").select(
        "conv_id", "position", "turn", "role", "body", "quote_levels", "parent_turn", "root_turn", "depth")


def quoting(messages: DataFrame) -> DataFrame:
    """``messages`` as a mail thread has them: every second turn quotes the one before, its quotes included.

    The text of the turn before stands in front, each line behind ``> ``. Of several rows of
    one turn the smallest text is quoted.
    """
    before = messages.groupBy(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t")).agg(F.min("text").alias("quoted"))
    marked = F.regexp_replace(F.concat(F.lit("> "), F.col("quoted")), "\n", "\n> ")
    answers = F.col("quoted").isNotNull() & (F.col("turn") % 2 == 0)
    text = F.when(answers, F.concat_ws("\n\n", marked, "text")).otherwise(F.col("text"))
    joined = messages.join(before, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left")
    return joined.select("conv_id", "turn", "role", text.alias("text"))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's messages hold no quotes, so its even turns quote the turn before first."""
    return link_quotes(quoting(table(spark, sf_dir, "conversations")))
