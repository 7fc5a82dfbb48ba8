"""Repair of damaged conversations at least cost.

A conversation is a word of symbols, one for each row: the initial of its role
and its fault. What its cheapest repair costs from some row on depends only on
the rows that follow, and on what the repaired part before it ended with. So
the words are kept by their ends: words that end alike share the nodes of their
end in one automaton, and each node gets, for each of four grammar states, its
cost to go, the edit that begins its best audit, and where that goes on.

Words are sorted from their last symbol on, so those that share an end stand
together and each node of a partition is made once; only the nodes of the word
at hand are held.

Of equally cheap audits the least in ASCII counts, D < I < K < R. At each node
and state at most one edit begins with each of these letters, so the letter
alone decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import cut
from .text import batches

# What edits cost, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = "\t\n\x0b\x0c\r "

#: Grammar states: nothing yet, after system, after user, after assistant; what each expects next. A repaired conversation ends in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: s, u, a or o for any other role; capitals for truncated rows; x for rows that must go.
KINDS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): conversations damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row (it stays here with ``gone`` and without a text, so that its
    conversation is known), 1 empties its text, 2 takes ``.!?`` out of it, 3
    doubles it, 4 makes it the user's. Nulls are read as one space, in the key,
    too; the turn itself stays null. Other columns are not carried.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")), F.lit(20))
    read = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") < 2, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return read.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def signatures(rows: DataFrame) -> DataFrame:
    """A row for each conversation of damaged rows: conv_id, gaps, blank, duplicate, truncated, illegal, and its word of symbols.

    Rows go by turn, nulls first, then by role and text. The word has one
    character for each row; texts are left behind.
    """
    of_conv = Window.partitionBy("conv_id", "gone").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    of_text = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("at")
    last = F.right(F.rtrim(F.translate("text", SPACES, " " * len(SPACES))), F.lit(1))
    pair = F.concat(F.lag("initial").over(of_conv), F.col("initial"))
    same = F.lag("turn").over(of_conv).eqNullSafe(F.col("turn"))
    marked = rows.repartition("conv_id").withColumns({"initial": F.left("role", F.lit(1)), "last": last})
    marked = marked.withColumns({"at": F.row_number().over(of_conv), "illegal": ~pair.isin("su", "ua", "au"), "same": same}).withColumn("again", F.row_number().over(of_text) > 1)
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    fault = F.when(F.col("last") == "", "blank").when(F.col("again"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    placed = marked.select("conv_id", "gone", "turn", fault.alias("fault"), kind.alias("kind"), "at", "illegal", "same")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("kind")).otherwise(F.col("kind"))
    here = ~F.col("gone")
    count = lambda c: F.count_if(here & c)
    turn = F.when(here, F.col("turn"))
    return placed.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - count(F.col("turn").isNotNull() & ~F.col("same")), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(here, F.struct("at", symbol.alias("s"))))), lambda p: p["s"]), "").alias("word"),
    )


#: What is left to do at the end of a word, by state: (cost, letter, next state, whether the row is used up).
Step = tuple[int, str, int, bool]


def _insertions(best: list[Step | None]) -> list[Step]:
    """The steps of a node once rows may be put in before it; each state has another way than that but at the end of a word."""
    far = 1 << 62
    cost = [b[0] if b else far for b in best]
    to_go = {USER: min(cost[USER], INSERT + cost[ASSISTANT]), ASSISTANT: min(cost[ASSISTANT], INSERT + cost[USER])}
    out = []
    for state, own in enumerate(best):
        value = INSERT + to_go[EXPECTED[state]]
        put = (value, "I", EXPECTED[state], False)
        out.append(min(own, put) if own else put)  # by cost, then by letter
    return out


#: Where no row is left: a conversation is whole when it is empty or ends with the assistant.
END: list[Step] = _insertions([(0, "", START, False), None, None, (0, "", ASSISTANT, False)])


def node(symbol: str, after: list[Step]) -> list[Step]:
    """The steps of the node with this symbol before the node with the steps ``after``."""
    kind, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    best: list[Step | None] = []
    for state in range(4):
        ways = [(DELETE + after[state][0], "D", state, True)]
        if symbol != "x":
            to = KINDS.get(kind)
            if to == EXPECTED[state] or (to == SYSTEM and state == START):
                ways.append((more + after[to][0], "K", to, True))
            to = EXPECTED[state]
            ways.append((REROLE + more + after[to][0], "R", to, True))
        best.append(min(ways))
    return _insertions(best)


def audit_of(nodes: list[list[Step]]) -> tuple[int, str]:
    """(cost, audit) of a word, from its nodes, the end first."""
    at, state, letters = len(nodes) - 1, START, []
    while True:
        _, letter, state, used = nodes[at][state]
        if not letter:
            return nodes[-1][START][0], "".join(letters)
        letters.append(letter)
        at -= used


def audits(words: Iterator[str]) -> Iterator[tuple[int, str]]:
    """(cost, audit) of each word. Nodes of an end that a word shares with the word before are used again, so sorted by their ends no node is made twice."""
    nodes, before, found = [END], "", (0, "")
    for word in words:
        if word != before:
            shared = 0
            for a, b in zip(reversed(word), reversed(before), strict=False):
                if a != b:
                    break
                shared += 1
            del nodes[shared + 1 :]
            for symbol in reversed(word[: len(word) - shared]):
                nodes.append(node(symbol, nodes[-1]))
            before, found = word, audit_of(nodes)
        yield found


def plan(conversations: DataFrame) -> DataFrame:
    """conversations (with ``word``) with the cost and the audit of the cheapest repair, dealt by ranges of their reversed words and, within a common word, of conv_id."""
    names = conversations.columns
    ends = F.reverse("word").alias("__end")
    dealt = conversations.select("*", ends).repartitionByRange("__end", "conv_id").sortWithinPartitions("__end").select(*names)
    at = names.index("word")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def words() -> Iterator[str]:
            for part in parts:
                if not part.num_rows:
                    continue
                held.append(part)
                yield from part.column(at).to_pylist()

        out: list[tuple[int, str]] = []
        for got in audits(words()):
            out.append(got)
            if len(out) == held[0].num_rows:
                part = held.pop()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c for c, _ in out], pa.int64()), pa.array([a for _, a in out], pa.string())], [*names, "cost", "audit"])
                out = []

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in conversations.schema)
    return dealt.mapInArrow(work, f"{schema}, cost long, audit string")


def _replay(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation; asks for a row only when an edit needs it."""
    state = START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = KINDS[role[0]]
        else:
            state = EXPECTED[state]
            role = NAMES[state]
        yield role, text


def repaired(rows: DataFrame, plans: DataFrame, *, digest: bool = False) -> DataFrame:
    """The repaired rows (conv_id, place, role, text), or with ``digest`` the plans with repaired_sha256 of ``role:text`` lines.

    Each conversation's plan is sent before its rows and the edits are made as
    the rows pass, a row at a time, so that the length of a conversation is no
    matter of memory.
    """
    keys = [f.name for f in plans.schema]
    types = dict(plans.dtypes)
    heads = plans.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("part"), F.struct(*keys).alias("plan"))
    body = rows.where("not gone").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(1).alias("part"), F.lit(None).cast(heads.schema["plan"].dataType).alias("plan"))
    both = heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "text")
    spark = rows.sparkSession
    batches(spark)
    size = 10_000

    def lines(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, str, str]]:
        for part in parts:
            for role, text, is_row, found in zip(*(part.column(c).to_pylist() for c in ("role", "text", "part", "plan")), strict=True):
                yield (None, role, text) if is_row else (found, "", "")

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
        """Each plan with its repaired rows, which must be read before the next plan."""
        stream = lines(parts)
        held = [next(stream, None)]

        def own() -> Iterator[tuple[str, str]]:
            while (line := next(stream, None)) is not None and line[0] is None:
                yield line[1], line[2]
            held[0] = line

        while held[0] is not None:
            found, held[0] = held[0][0], None
            mine = own()
            yield found, _replay(mine, found["audit"])
            for _ in mine:  # rows behind the last edit: none, but the next plan is found so
                pass

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for found, kept in each(parts):
            whole, between = hashlib.sha256(), b""
            for role, text in kept:
                whole.update(between + f"{role}:{text}".encode())
                between = b"\n"
            out.append({**found, "repaired_sha256": whole.hexdigest()})
            if len(out) >= size:
                yield pa.RecordBatch.from_pylist(out, schema=target)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=target)

    def written(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held = 0
        for found, kept in each(parts):
            for place, (role, text) in enumerate(kept):
                out.append({"conv_id": found["conv_id"], "place": place, "role": role, "text": text})
                held += len(text)
                if len(out) >= size or held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=target)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    columns = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", repaired_sha256 string" if digest else f"conv_id {types['conv_id']}, place long, role string, text string"
    empty = spark.createDataFrame([], columns)
    target = to_arrow_schema(empty.schema)
    return both.select("role", "text", "part", "plan").mapInArrow(hashed if digest else written, columns)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation after :func:`damage`.

    A row's first fault counts: blank, the same role and text as an earlier
    row, not ended by ``.!?``. The audit has the initials of the cheapest edits
    (keep, rerole, delete, insert) that leave an optional system turn and pairs
    of user and assistant, or nothing. Conversations without a row have zeros,
    an empty audit and the hash of nothing. Null conv_ids are one conversation,
    rows with a null turn come first, equal rows follow each other. Empty
    tables give no rows. Other columns don't matter.
    """
    hurt = damage(rows)
    plans = plan(cut(signatures(hurt))).drop("word")  # kept, as dealing by ranges reads its input twice
    return repaired(hurt, plans, digest=True)
