"""What several operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.session import written

#: The white space that parts words everywhere in this subpackage: 0x20 and 0x09 to 0x0D.
SPACES = " \t\n\x0b\f\r"
#: A word, as Java and DuckDB regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Rows of text per Arrow batch, and its bytes: bounds the memory of Python workers.  Plans read them when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def row_order(doc_id: Column, text: Column) -> Column:
    """A pseudo-random but lasting rank of a row by its id and text: 60 bits of their MD5, which SQL engines share."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(key, row) of each row of ``docs``, and whether keys are its ids; keys are unique and last.

    Where ids are integers, none is null and none repeats, they are the keys.  Otherwise rows are
    numbered and written once, so that equal rows are told apart the same way each time they are read.
    """
    if docs.schema["doc_id"].dataType.typeName() in ("long", "integer"):
        if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count() == 0:
            return docs.select(F.col("doc_id").cast("long").alias("key"), F.struct("*").alias("row")), True
    return written(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row"))), False


def running_before(df: DataFrame, keys: Sequence[str], order: str, then: Sequence[str], values: dict[str, str], rows: int, per_bucket: int = 5_000) -> DataFrame:
    """Adds, for each ``new: value`` of ``values``, the sum of ``value`` over the rows before this one among those with equal ``keys``.

    Rows come by ``order`` (a 60-bit rank that is spread evenly), ties by ``then``.  A key may hold
    any share of all rows: its rows are cut by the leading bits of ``order`` into buckets of about
    ``per_bucket`` rows, buckets are summed on the map side, and a running sum over the few bucket
    sums is added to the running sums within buckets.  ``df`` is read twice and should be durable;
    ``rows`` is its number of rows.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows / per_bucket))))
    df = df.withColumn("__bucket", F.shiftright(F.col(order), 60 - bits))
    keyed = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    sums = df.groupBy(*keys, "__bucket").agg(*(F.sum(v).alias(f"__sum_{new}") for new, v in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__bucket").alias("__b"), *(F.coalesce(F.sum(f"__sum_{new}").over(earlier), F.lit(0)).alias(f"__base_{new}") for new in values))
    on = F.col("__bucket") == F.col("__b")
    for k in keyed:
        on = on & k
    within = Window.partitionBy(*keys, "__bucket").orderBy(order, *then).rowsBetween(Window.unboundedPreceding, -1)
    out = df.select("*", *(F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"__in_{new}") for new, v in values.items()))
    out = out.join(sums, on, "left")
    return out.select(*(c for c in df.columns if c != "__bucket"), *((F.col(f"__base_{new}") + F.col(f"__in_{new}")).alias(new) for new in values))


def union_find(n: int) -> tuple[Callable[[int], int], Callable[[int, int], bool]]:
    """find(i), and join(i, j), which is False if they were together; the smaller index becomes the root."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> bool:
        i, j = find(i), find(j)
        if i == j:
            return False
        parent[max(i, j)] = min(i, j)
        return True

    return find, join
