"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

The documents of a source queue in the order of a hash of their id and text, and the queue may be
passed three times (``EPOCHS``).  A copy of a document finishes, in virtual time, when its source has
served all words before it and its own at a rate of the source's weight: finish = words served /
weight.  All copies are range-sorted by finish time and cut where their words reach the budget, the
words of all documents: copies before the cut are taken, the copy at the cut in part.  Sources whose
three passes are over leave the queue and the others share on, so targets fill up like water, and each
source's taken words come within a document of its target.

Scale.  Words are counted in one pass; the table of (id, source, words) is checkpointed.  Running
sums within a source are two-level (see ``running_before``), so a source may hold any share of all
rows.  The sort is a range partitioning of narrow rows: sums per partition tell which one the cut lies
in, only that one is summed up row by row, and every document is then held against the one row of the
cut.  Only tables of one row per source, per source and bucket, or per partition are joined to rows or
sorted in one task.

Edge cases.  A null source is a source of its own, the last.  Null and empty texts have 0 words and
are never taken.  Rows are queued one by one, so repeated rows each have their place; equal rows are
interchangeable.  A source without words has the target 0; an empty table gives an empty result.
Extra columns, whatever their names, are carried along by ``mixed`` and not read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import WORD, keyed, row_order, running_before
from voxloom.session import durable

#: Weights of the sources in their order, again and again.
WEIGHTS = (5, 2, 1)
#: No document is taken more often.
EPOCHS = 3


def words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, place, weight, target) of each row (source, source_size).

    Sources are sorted by how soon their passes end (cap / weight).  The first for which an even
    share of what is left stays below its cap sets the level; all before it end at their caps.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    out = sums.withColumn("place", place).withColumn("weight", cycle.cast("double")).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    by_end = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, after = by_end.rowsBetween(Window.unboundedPreceding, -1), by_end.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    out = out.withColumn("share", left / F.sum("weight").over(after))
    out = out.withColumn("level", F.min(F.when(F.col("share") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "share"))).over(everything)["share"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return out.select("source", "source_size", F.col("place").cast("long").alias("place"), "weight", target.alias("target"))


def finish(lap: int) -> Column:
    """The virtual time at which a document's copy of a pass ends."""
    return (F.col("before") + F.col("size") + F.lit(lap) * F.col("source_size")) / F.col("weight")


def cut(copies: DataFrame, budget: int) -> tuple[float, int, int]:
    """(finish, place, words taken) of the copy at which the words of the sorted ``copies`` reach the budget.

    No two copies share finish and place: within a source each ends later than the one before.
    """
    parts = copies.repartitionByRange("finish", "place").withColumn("part", F.spark_partition_id())
    parts = durable(parts)
    sums = parts.groupBy("part").agg(F.sum("size").alias("words"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    at = sums.where((F.col("ahead") < budget) & (F.col("ahead") + F.col("words") >= budget)).first()
    within = Window.partitionBy("part").orderBy("finish", "place").rowsBetween(Window.unboundedPreceding, -1)
    own = parts.where(F.col("part") == at["part"]).withColumn("ahead", F.lit(at["ahead"]) + F.coalesce(F.sum("size").over(within), F.lit(0)))
    last = own.where((F.col("ahead") < budget) & (F.col("ahead") + F.col("size") >= budget)).first()
    return last["finish"], last["place"], budget - last["ahead"]


def served(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Adds to each row (key, doc_id, source, text) its size and, by pass, an array ``copies`` of (finish, place, words taken).

    text goes; source_size and target are those of the row's source.
    """
    sized = durable(rows.select("key", "doc_id", "source", words(F.col("text")).alias("size"), row_order(F.col("doc_id"), F.col("text")).alias("rank")))
    sums = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    n, budget = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    queued = running_before(sized, ["source"], "rank", ["doc_id", "size"], {"before": "size"}, n)
    goal = targets(sums.drop("n"), weights, epochs).withColumnRenamed("source", "__source")
    out = queued.join(goal, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source", "rank")
    taken = [F.lit(0).cast("long")] * epochs
    if budget:
        out = durable(out)
        every = F.explode(F.array(*map(finish, range(epochs)))).alias("finish")
        time, place, part = cut(out.where("size > 0").select("size", "place", every), budget)
        for lap in range(epochs):
            first = (finish(lap) < time) | ((finish(lap) == time) & (F.col("place") < place))
            at = (finish(lap) == time) & (F.col("place") == place)
            taken[lap] = F.when(F.col("size") == 0, 0).when(first, F.col("size")).when(at, part).otherwise(0).cast("long")
    copies = [F.struct(finish(lap).alias("finish"), "place", taken[lap].alias("taken")) for lap in range(epochs)]
    return out.select("key", "doc_id", "source", "size", "source_size", "target", F.array(*copies).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row (doc_id, text, source)."""
    out = served(docs.select(F.lit(None).alias("key"), "doc_id", "source", "text"), weights, epochs)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["taken"])
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of ``docs`` as the mix serves them: each as often as the mix takes it, sorted by virtual finish time.

    Copies are whole: the one at the cut is there if half its words or more are.  The columns are those
    of ``docs``; each row is decided on its own, also where ids repeat or are null.
    """
    rows, _ = keyed(docs)
    plan = served(rows.select("key", *(F.col(f"row.{c}").alias(c) for c in ("doc_id", "source", "text"))), weights, epochs)
    plan = plan.where("size > 0").select(F.col("key").alias("__key"), F.explode(F.filter("copies", lambda c: 2 * c["taken"] >= F.col("size"))).alias("copy"))
    rows = rows.join(plan, F.col("key") == F.col("__key")).orderBy("copy.finish", "copy.place")
    return rows.select("row.*")
