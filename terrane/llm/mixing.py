"""Mixing sources to target weights by weighted fair queueing.

Sources get targets from cyclic weights, capped at ``max_epochs`` times their
size, the excess reshared (a water level: target = min(cap, weight * level)).
Each source's documents, in a hashed order and once per epoch, get a virtual
finish time: the words that the source has queued up to and including the
document, divided by the source's target.  All copies of all sources are then
ordered by finish time over fixed ranges of it, and the order is cut where the
total budget is reached.

Only window and aggregate functions are used.  A running sum over a source
(which may hold a third of all rows) is never one task: rows are summed by
(source, hash range) first, the ranges' sums are accumulated, and the running
sum inside one range is a window over that range alone.  The cut works the
same way over ranges of finish time.  Per-source figures (name, size, weight)
form a table of one row a source; it is accumulated in one small window.

Defined results: null text has size 0; the null source is a source, last in
order; rows of size 0 are taken 0 times; repeated rows and repeated ids are
rows of their own (order ties break by a hash of the text); texts of any
length are counted whole; an empty table gives an empty result; further columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.text import word_count
from terrane.workspace import Workspace

#: Ranges of the hashed order within a source, and of finish time.  The rows
#: of one range are summed in one task: at 10**11 rows, about 10**6 of them.
RANGES = 1 << 16


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(key, source, source_size) -> the same with target.

    Water filling in one pass: sources sorted by cap / weight fill up in that
    order; the level is the one at which capped sources plus weight * level of
    the rest meet the budget.
    """
    everything = Window.partitionBy(F.lit(1))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(max_epochs)
    s = ranked.withColumn("weight", weight).withColumn("cap", cap).withColumn("budget", F.sum("source_size").over(everything) * share)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # A source is below its cap when the level that it would be given is; all later sources share that first level.
    s = s.withColumn("level", level)
    reached = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)
    s = s.withColumn("reached", F.coalesce(reached["level"], F.lit(float("inf"))))
    return s.select("key", "source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("reached")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document."""
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    # A hash that SQL engines have too, as hexadecimal text.
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))
    sized = ws.keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("turn")), "sized")
    # A key that is never null and tells the null source from the empty name.
    key = F.concat(F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce("source", F.lit("")))
    rows = sized.select("doc_id", "source", "size", "turn", key.alias("key"), F.conv(F.substring("turn", 1, 4), 16, 10).cast("int").alias("slot"))

    # Words queued before each hash range of each source.
    sums = rows.groupBy("key", "slot").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    sums = ws.keep(sums.withColumn("group", F.shiftright("slot", 8)), "sums")
    groups = sums.groupBy("key", "group").agg(F.sum("words").alias("words"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("key", "group", F.coalesce(F.sum("words").over(before("key").orderBy("group")), F.lit(0)).alias("ahead"))
    in_group = F.coalesce(F.sum("words").over(before("key", "group").orderBy("slot")), F.lit(0))
    queued = sums.withColumn("in_group", in_group).join(groups, ["key", "group"]).select("key", "slot", (F.col("ahead") + F.col("in_group")).alias("queued"))
    targets = ws.keep(source_targets(sums.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")), weights, share, max_epochs), "targets")
    slots = queued.join(targets.select("key", "source_size", "target"), "key")

    within = Window.partitionBy("key", "slot").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    timed = rows.withColumn("own", F.sum("size").over(within)).join(slots, ["key", "slot"])
    # Finish time of the copy of epoch e: words of the earlier epochs, of the earlier ranges, and of this range up to the row.
    finish = lambda e: (F.col("source_size") * e + F.col("queued") + F.col("own")) / F.col("target")
    copies = F.array(*[F.when(F.col("target") > 0, finish(e)) for e in range(max_epochs)])
    timed = ws.keep(timed.select("doc_id", "source", "size", "source_size", "target", "turn", copies.alias("finish")), "timed")

    # Where the budget is reached: ranges of finish time, then the rows of one range.
    span = F.least(F.lit(RANGES * max_epochs * 64), F.floor(F.col("f") * RANGES)).cast("long")
    queue = timed.select("size", "doc_id", "turn", F.explode("finish").alias("f")).filter("f is not null").withColumn("span", span)
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    last = _cut(queue, budget * share)
    n = F.aggregate("finish", F.lit(0), lambda a, f: a + F.when(f < F.lit(last), 1).otherwise(0))
    return timed.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * n).alias("taken"))


def _cut(queue: DataFrame, budget: float) -> float:
    """Finish time of the first row that no longer fits: found in groups of
    ranges, then in the ranges of one group, then in the rows of one range."""
    spent = 0
    for key in ("group", "span"):
        sums = queue.withColumn("group", F.shiftright("span", 8)).groupBy(key).agg(F.sum("size").alias("words"))
        up_to = F.sum("words").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) + spent
        over = sums.withColumn("up_to", up_to).filter(F.col("up_to") > budget).orderBy(key).select(key, "up_to", "words").first()
        if over is None:
            return float("inf")
        spent = over["up_to"] - over["words"]
        queue = queue.filter((F.shiftright("span", 8) if key == "group" else F.col("span")) == over[key])
    in_range = Window.partitionBy("span").orderBy("f", "turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = queue.withColumn("up_to", F.sum("size").over(in_range) + spent)
    return rows.filter(F.col("up_to") > budget).agg(F.min("f")).first()[0]


def op9(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
