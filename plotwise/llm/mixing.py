"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow that serves its documents in a fixed pseudo-random
order, and after the last one starts over, ``max_epochs`` times at most. The
virtual finish time of a document is the number of its source's words served
up to its end, divided by the source's weight. The mix is the sequence of all
documents in order of virtual finish time, cut where the total reaches the
budget. Sources that have run dry have nothing left to serve, so what they
leave goes by weight to the others.

Built from DataFrame operations only. A source may hold any share of the rows:
it is dealt over ranges of its pseudo-random order, summed within each range,
and only the sums of the ranges are accumulated per source. Likewise virtual
time is dealt into ranges; only the range in which the budget is reached is
sorted row by row to find the cut, and what stands before the cut is the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import cut

WORDS = r"[^\x20\x09-\x0D]+"
PLAN_COLUMNS = ("size", "source_size", "weight", "target", "words_before", "epochs", "taken", "virtual_finish")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Weights that repeat ``cycle`` over the sources by code point, null last. ``sources``: a row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (rank % len(cycle) + 1).cast("int"))
    return sources.select("source", pick.alias("weight"))


def _key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _sized(docs: DataFrame, carried: list[str], seed: str, buckets: int) -> DataFrame:
    """doc (the carried columns), key, place (of the row in its source's order, a struct), bucket (the range of the order), size."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select(F.struct(*carried).alias("doc"), _key(F.col("source")).alias("key"), F.col("source"), F.col("doc_id").cast("long").alias("doc_id"), order.alias("order"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    bucket = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int")
    return rows.withColumns({"place": F.struct("order", "doc_id", "size", "tie"), "bucket": bucket})


def _flows(parts: DataFrame, weights: DataFrame | None, budget_share: float, max_epochs: int) -> DataFrame:
    """key, source_size, weight, target, level, budget: a row for each source."""
    flows = parts.groupBy("key").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    weights = cycled_weights(flows.select("source")) if weights is None else weights.select("source", F.col("weight").cast("double"))
    flows = flows.join(weights.select(_key(F.col("source")).alias("key"), "weight"), "key", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    # The targets: the level of virtual time at which the flows, each up to its cap, would have served the budget word by word.
    cap = F.when(F.col("weight") > 0, F.col("source_size").cast("double") * max_epochs).otherwise(0.0)
    flows = flows.withColumns({"cap": cap, "dry": F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(0.0)})
    every, earlier = Window.partitionBy(), Window.orderBy("dry", "key").rowsBetween(Window.unboundedPreceding, -1)
    flows = flows.withColumns({"budget": F.least(F.sum(F.col("source_size").cast("double")).over(every) * F.lit(float(budget_share)), F.sum("cap").over(every)), "all_weight": F.sum("weight").over(every)})
    left = F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    level = F.when(F.col("weight") > 0, left / (F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    flows = flows.withColumn("level", level)
    flows = flows.withColumn("level", F.coalesce(F.max(F.when(F.col("level") <= F.col("dry"), F.col("level"))).over(every), F.max("dry").over(every)))
    return flows.select("key", "source_size", "weight", F.least(F.col("weight") * F.col("level"), F.col("cap")).alias("target"), "level", "budget")


def _queued(sized: DataFrame, starts: DataFrame, flows: DataFrame) -> DataFrame:
    """sized with words_before, and the source's size, weight and target."""
    within = Window.partitionBy("key", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    # starts and flows hold a row per range and per source; Spark broadcasts them by their measured size.
    placed = sized.withColumn("upto", F.sum("size").over(within)).join(starts, ["key", "bucket"]).join(flows.drop("level", "budget"), "key")
    return placed.withColumn("words_before", F.col("start") + F.col("upto") - F.col("size"))


def _turn(epoch: Column | int) -> Column:
    """The place of a document's epoch in the queue: virtual finish time first."""
    epoch = epoch if isinstance(epoch, Column) else F.lit(epoch)
    finish = (epoch.cast("long") * F.col("source_size") + F.col("words_before") + F.col("size")) / F.col("weight")
    return F.struct(finish.alias("finish"), F.col("key").alias("key"), epoch.cast("int").alias("epoch"), F.col("place").alias("place"))


def _plan(docs: DataFrame, carried: list[str], weights: DataFrame | None, budget_share: float, max_epochs: int, seed: str, per_range: int, ranges: int) -> DataFrame:
    # As many ranges of a source's order as keep each of them small enough to be sorted by one task, whatever the number of rows.
    buckets = max(64, docs.count() // per_range)
    narrow = cut(_sized(docs.select("doc_id", "source", "text"), ["doc_id"], seed, buckets).drop("doc"))
    parts = narrow.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(parts.select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start")))
    flows = cut(_flows(parts, weights, budget_share, max_epochs))

    whole = flows.agg(F.max("budget"), F.max("level")).first()
    budget, level = whole[0] or 0.0, whole[1] or 0.0
    within = lambda e: F.lit(False)
    if budget > 0:
        # Ranges of virtual time up to twice the level, where the budget is served unless documents are as long as what is left.
        reach = lambda finish: F.least(F.floor(finish / F.lit(level / ranges)), F.lit(2 * ranges))
        queue = _queued(narrow, starts, flows).where("weight > 0 and size > 0").select("size", F.explode(F.array(*[_turn(e) for e in range(max_epochs)])).alias("turn"))
        queue = queue.withColumn("range", reach(F.col("turn.finish")))
        sums = queue.groupBy("range").agg(F.sum("size").alias("words"))
        reached = sums.select("range", (F.sum("words").over(Window.orderBy("range")) - F.col("words")).alias("served"))
        crossing = reached.where(F.col("served") <= F.lit(budget)).orderBy(F.desc("range")).first()
        # The budget is reached in this range. Its documents are put in order; one that crosses the budget counts if at least half of it fits.
        served = F.lit(crossing["served"]) + F.sum("size").over(Window.partitionBy("range").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        inside = queue.where(F.col("range") == crossing["range"]).withColumn("served", served)
        last = inside.where(2 * F.col("served") + F.col("size") <= F.lit(2 * budget)).agg(F.max("turn").alias("turn")).first()["turn"]
        if last is None:  # the mix ends where that range begins
            within = lambda e: reach(_turn(e)["finish"]) < F.lit(crossing["range"])
        else:
            place = last["place"]
            cell = F.struct(F.lit(place["order"]).alias("order"), F.lit(place["doc_id"]).cast("long").alias("doc_id"), F.lit(place["size"]).cast("long").alias("size"), F.lit(place["tie"]).cast("long").alias("tie"))
            edge = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["key"]).alias("key"), F.lit(last["epoch"]).cast("int").alias("epoch"), cell.alias("place"))
            within = lambda e: _turn(e) <= edge

    rows = _queued(_sized(docs, carried, seed, buckets), starts, flows)
    times = sum((F.when(within(e), 1).otherwise(0) for e in range(max_epochs)), F.lit(0))
    epochs = F.when((F.col("weight") > 0) & (F.col("source_size") > 0), times).otherwise(0)
    return rows.withColumn("epochs", epochs.cast("int"))


def mix_plan(docs: DataFrame, weights: DataFrame | None = None, *, columns: list[str] | None = None, budget_share: float = 1.0, max_epochs: int = 3, seed: str = "mix", per_range: int = 20_000, ranges: int = 4096) -> DataFrame:
    """docs (or the given columns of it) with each document's place in the mix.

    Adds ``size`` (words), ``source_size``, ``weight``, ``target`` (words that
    the mix should take from the source), ``words_before`` (words of the source
    that come before in an epoch), ``epochs`` (how often the document is in the
    mix), ``taken`` (``size * epochs``) and ``virtual_finish`` (of its first
    epoch). All documents up to the budget in order of virtual finish time are
    taken, so a source ends within a document of what the cut gives it.

    ``weights``: (source, weight), else 1, 2, 3 in turn. ``budget_share``: the
    mix's words over all words; at most ``max_epochs`` is of use.

    Null texts have no words; a null source is a source of its own; sources
    missing from ``weights`` or with a weight of 0 are not taken. Documents of
    equal finish time follow by source, epoch and order, repeated rows, which
    are documents of their own, by size and text. A column of docs named like
    an added one is replaced. An empty table gives an empty plan.
    """
    carried = [c for c in (docs.columns if columns is None else columns) if c not in PLAN_COLUMNS]
    rows = _plan(docs, carried, weights, budget_share, max_epochs, seed, per_range, ranges)
    finish = F.when(F.col("weight") > 0, (F.col("words_before") + F.col("size")) / F.col("weight"))
    return rows.select("doc.*", "size", "source_size", "weight", "target", "words_before", "epochs", (F.col("size") * F.col("epochs")).alias("taken"), finish.alias("virtual_finish"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, *, budget_share: float = 1.0, max_epochs: int = 3, seed: str = "mix", per_range: int = 20_000, ranges: int = 4096) -> DataFrame:
    """The mix itself: the columns of docs, a row for each time a document is taken, plus ``epoch`` and ``virtual_finish``.

    The rows are range-sorted by virtual finish time over the whole cluster.
    All columns of docs are kept as they are; where docs has a column named
    like an added one, that one isn't added. Documents without words are not in
    the mix unless their finish time is before the cut. Options and special
    cases as in :func:`mix_plan`.
    """
    rows = _plan(docs, docs.columns, weights, budget_share, max_epochs, seed, per_range, ranges).where("epochs > 0")
    turns = rows.select("doc", F.explode(F.transform(F.sequence(F.lit(0), F.col("epochs") - 1), lambda e: _turn(e))).alias("turn")).orderBy("turn")
    added = {"epoch": F.col("turn.epoch"), "virtual_finish": F.col("turn.finish")}
    return turns.select("doc.*", *(c.alias(name) for name, c in added.items() if name not in docs.columns))
