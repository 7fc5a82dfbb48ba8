"""Chat formatting of reply trees.

Messages point to the message they answer. Paths from each root to each leaf
are found by self-joins on pointers that double their reach each time, so that
a chain of any length takes a logarithmic number of joins. Branches are ranked
by score, and each path that is chosen becomes one conversation.

The template writes a turn as ``### role: text </turn>`` and a line break.
Inside roles and texts each backslash, ``#`` and ``<`` gets a backslash before
it, and in roles each colon too; so neither mark can stand inside, and taking
the backslashes away gives back what was written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import cut
from .text import batches

# The template.
OPEN, CLOSE, LOSS_ROLE = "### ", " </turn>\n", "assistant"
_TEXT, _ROLE, _BACK = re.compile(r"([\\#<])"), re.compile(r"([\\#<:])"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(the turn as the template writes it, start and end of the escaped text in it)."""
    head = OPEN + _ROLE.sub(r"\\\1", role) + ": "
    body = _TEXT.sub(r"\\\1", text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def unescape(body: str) -> str:
    return _BACK.sub(r"\1", body)


def reply_paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf_id, depth, msg_id, score): for every leaf, the messages from its root (depth 0) to it.

    ``messages``: conv_id, msg_id (unique in its conversation), parent_id (null
    at a root), score. A message whose parent isn't there is a root, too.
    Messages on a cycle, or below one, have no root and are in no path.
    """
    nodes = cut(messages.select("conv_id", "msg_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    known = nodes.select("conv_id", F.col("msg_id").alias("up"))
    # Level k holds the ancestor 2**k further up of each message that has one.
    levels = [cut(nodes.select("conv_id", "msg_id", F.col("parent_id").alias("up")).where("up is not null").join(known, ["conv_id", "up"]).select("conv_id", "msg_id", "up"))]
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    while 1 << (len(levels) - 1) <= most and not levels[-1].isEmpty():
        last = levels[-1]
        levels.append(cut(last.join(last.select("conv_id", F.col("msg_id").alias("up"), F.col("up").alias("top")), ["conv_id", "up"]).select("conv_id", "msg_id", F.col("top").alias("up"))))
    # What still has an ancestor further up than a conversation is long goes round a cycle.
    parents = levels[0].select("conv_id", F.col("up").alias("msg_id")).union(levels[-1].select("conv_id", "msg_id")).distinct()
    leaves = nodes.join(parents, ["conv_id", "msg_id"], "left_anti")
    # Each leaf with all its ancestors: a round adds those 1, 2, 4, ... steps above what is known.
    paths = leaves.select("conv_id", F.col("msg_id").alias("leaf_id"), "msg_id", F.lit(0).cast("long").alias("up_steps"))
    for k, level in enumerate(levels[:-1]):
        above = level.withColumnRenamed("up", "above")
        paths = cut(paths.union(paths.join(above, ["conv_id", "msg_id"]).select("conv_id", "leaf_id", F.col("above").alias("msg_id"), (F.col("up_steps") + (1 << k)).alias("up_steps"))))
    depth = F.max("up_steps").over(Window.partitionBy("conv_id", "leaf_id")) - F.col("up_steps")
    return paths.join(nodes.select("conv_id", "msg_id", "score"), ["conv_id", "msg_id"]).select("conv_id", "leaf_id", depth.alias("depth"), "msg_id", "score")


def choose_paths(paths: DataFrame, *, branches: int | None = 1) -> DataFrame:
    """The ``branches`` best paths of each conversation (None: all), with their ``rank``: by mean score of the messages, then the longer, then the smaller leaf."""
    scored = paths.groupBy("conv_id", "leaf_id").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("mean"), F.desc("n"), "leaf_id")))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    return paths.join(ranked.select("conv_id", "leaf_id", "rank"), ["conv_id", "leaf_id"])


def format_trees(messages: DataFrame, *, branches: int | None = 1) -> DataFrame:
    """(conv_id, leaf_id, rank, formatted, loss_spans): a row for each chosen path.

    ``messages``: conv_id, msg_id, parent_id, score, role, text. loss_spans are
    the (start, end) in characters of the escaped texts of assistant turns.

    Null roles and texts count as empty; null conv_ids form one conversation,
    null msg_ids one message. Of several rows with one msg_id in a conversation
    the first by parent_id, score, role and text holds, nulls first, so a
    repeated message is one turn. Other columns are not carried; no rows give
    no rows. The turns of a path
    are sorted by the shuffle and written one after the other; a task holds
    the conversation that it is writing, which is one row of the result.
    """
    spark = messages.sparkSession
    batches(spark)
    none = F.lit(-(1 << 63))  # stands for null ids
    safe = messages.select(F.coalesce(F.col("conv_id").cast("long"), none).alias("conv_id"), F.coalesce(F.col("msg_id").cast("long"), none).alias("msg_id"), F.col("parent_id").cast("long").alias("parent_id"), F.col("score").cast("double").alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Texts are shuffled here, and again when the turns of a path come together; paths are found without them.
    safe = cut(safe.groupBy("conv_id", "msg_id").agg(F.min(F.struct("parent_id", "score", "role", "text")).alias("m")).select("conv_id", "msg_id", "m.*"))
    chosen = choose_paths(reply_paths(safe), branches=branches)
    rows = safe.select("conv_id", "msg_id", "role", "text").join(chosen, ["conv_id", "msg_id"]).select("conv_id", "leaf_id", "rank", "depth", "role", "text")
    rows = rows.repartition("conv_id", "leaf_id").sortWithinPartitions("conv_id", "leaf_id", "depth")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        held, pieces, spans, size = None, [], [], 0

        def done(out: list) -> None:
            if held is not None:
                out.append((*held, "".join(pieces), spans))

        def batch(out: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conv_id", "leaf_id", "rank", "formatted", "loss_spans"])

        for part in parts:
            out: list = []
            for conv, leaf, rank, _, role, text in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                if (conv, leaf, rank) != held:
                    done(out)
                    held, pieces, spans, size = (conv, leaf, rank), [], [], 0
                turn, start, end = format_turn(role, text)
                if role == LOSS_ROLE:
                    spans.append({"start": size + start, "end": size + end})
                pieces.append(turn)
                size += len(turn)
            if out:
                yield batch(out)
        out = []
        done(out)
        if out:
            yield batch(out)

    schema = "conv_id long, leaf_id long, rank long, formatted string, loss_spans array<struct<start:long,end:long>>"
    found = rows.mapInArrow(work, schema)
    return found.withColumns({c: F.when(F.col(c) != none, F.col(c)) for c in ("conv_id", "leaf_id")})


def chains(turns: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as messages that each answer the one before, by turn, role and text; null turns come last."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    place = F.row_number().over(order).cast("long")
    rows = turns.select("conv_id", place.alias("msg_id"), "role", "text")
    return rows.withColumns({"parent_id": F.when(F.col("msg_id") > 1, F.col("msg_id") - 1), "score": F.lit(0.0)})


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from :func:`format_trees`: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                turns = parse(text)
                every, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, body, _, _ in turns:
                    every.update(f"{role}\n{body}\n".encode())
                for s in spans:
                    body = unescape(text[s["start"] : s["end"]])
                    loss.update(body.encode())
                    chars += len(body)
                rows.append((len(turns), every.hexdigest(), chars, loss.hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(work, schema)
