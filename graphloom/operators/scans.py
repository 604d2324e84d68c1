"""Places, running totals and greedy cuts along ordered groups, of which one may hold most of all rows.

Rows are ranged by group and order, so that a large group lies in many ranges; each range is
scanned by itself, and what the ranges before it come to, a few numbers a range, is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import stored
from . import hierarchy

#: Rows that one task looks at together when neighbours are compared.
STRIP = 1024


def running(df: DataFrame, group: list[str], order: list[str], **sums: Column) -> DataFrame:
    """df, stored, with ``idx``, each row's place in its group from 1 on, ``n``, the group's rows, and the running totals of ``sums``, the row's own included.

    Order must tell rows of a group apart, or it is arbitrary among equals, but the same in all totals. Null
    summands, columns named by F.col, count as 0. Columns of df keep their names; group columns may be null.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    rows = stored(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "ranged")
    totals = {"idx": F.lit(1).cast("long"), **sums}
    own = Window.partitionBy(*group, "__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = rows.select("*", *(F.sum(F.coalesce(c, F.lit(0))).over(own).alias(f"__{k}") for k, c in totals.items()))
    chunk = rows.groupBy(*group, "__part").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(f"__c_{k}") for k, c in totals.items()))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    heads = chunk.select(*(F.col(g).alias(f"__g_{g}") for g in group), F.col("__part").alias("__p"), F.sum("__c_idx").over(whole).alias("n"), *(F.coalesce(F.sum(f"__c_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in totals))
    same = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group] + [F.col("__part") == F.col("__p")]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    out = scanned.join(heads, condition)
    return out.select(*df.columns, "n", *((F.col(f"__{k}") + F.col(f"__b_{k}")).alias(k) for k in totals))


def with_previous(df: DataFrame, group: str, columns: list[str], strip: int = STRIP) -> DataFrame:
    """Rows with ``idx`` (places from 1 on without gaps) beside the p_columns of the row before in their group; a group's first row has none and is left out.

    Neighbours meet in strips of places; a strip's last row is there in the next one too.
    """
    last = (F.col("idx") % strip == strip - 1) & (F.col("idx") > 0)
    at = F.floor(F.col("idx") / strip)
    halo = F.when(last, F.array(F.struct(at.alias("s"), F.lit(True).alias("own")), F.struct((at + 1).alias("s"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(at.alias("s"), F.lit(True).alias("own"))))
    rows = df.withColumn("__h", F.explode(halo)).withColumn("__s", F.col("__h.s")).withColumn("__own", F.col("__h.own")).drop("__h")
    w = Window.partitionBy(group, "__s").orderBy("idx")
    beside = rows.select("*", F.lag(F.lit(1)).over(w).alias("__two"), *(F.lag(c).over(w).alias(f"p_{c}") for c in columns))
    return beside.where("__own and __two is not null").drop("__s", "__own", "__two")


def last_within(rows: DataFrame, width: float) -> DataFrame:
    """(group, idx, last): the last place whose running total ``total`` is at most width more than what the places before idx come to; a place itself at least.

    Totals must not fall. Places meet in buckets of the total as wide as ``width``: what one asks
    for lies in the next bucket, or is the last of its own.
    """
    bucket = lambda c: F.floor(c / F.lit(float(width))).cast("long")
    # A place's total, and the zero before the first, which stands for place 0.
    at = rows.select("group", "idx", F.col("total").cast("double").alias("v")).unionByName(rows.where("idx = 1").select("group", (F.col("idx") - 1).alias("idx"), F.lit(0.0).alias("v")))
    at = at.withColumn("b", bucket(F.col("v")))
    carried = at.groupBy("group", "b").agg(F.max("idx").alias("idx")).select("group", (F.col("b") + 1).alias("b"), F.lit(0).alias("kind"), F.lit(float("-inf")).alias("v"), F.col("idx").alias("j"), F.lit(None).cast("long").alias("i"))
    own = at.select("group", "b", F.lit(0).alias("kind"), "v", F.col("idx").alias("j"), F.lit(None).cast("long").alias("i"))
    asks = at.select("group", (F.col("b") + 1).alias("b"), F.lit(1).alias("kind"), (F.col("v") + float(width)).alias("v"), F.lit(None).cast("long").alias("j"), (F.col("idx") + 1).alias("i"))
    w = Window.partitionBy("group", "b").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = own.unionByName(carried).unionByName(asks).withColumn("last", F.max("j").over(w)).where("kind = 1")
    # What is asked beyond the last place has no row.
    return rows.select("group", "idx").join(found.select("group", F.col("i").alias("idx"), "last"), ["group", "idx"]).select("group", "idx", F.greatest("idx", "last").alias("last"))


def greedy_starts(cuts: DataFrame) -> DataFrame:
    """(group, idx) of the places where runs begin: the first, and the one behind the ``last`` of each run, over cuts (group, idx, last) of all places.

    Which places are on the way from the first one is found by doubling: as many rounds as the
    logarithm of the longest chain of runs.
    """
    key = lambda i: F.concat_ws("\u001f", "group", i.cast("string"))
    named = stored(cuts.select("group", "idx", key(F.col("idx")).alias("node_id"), key(F.col("last") + 1).alias("parent")), "cuts")
    on = hierarchy.upward(named.where("idx = 1").select("node_id"), named.select(F.col("node_id").alias("child"), "parent"))
    return named.join(on, "node_id", "left_semi").select("group", "idx")
