"""Interleaving sources at target weights by Pfair scheduling, with DataFrame functions alone.

A source of weight w owes its i-th block between its release floor(i / w) and its deadline
ceil((i + 1) / w); the earliest deadline among the released blocks goes next. Weights are whole
numbers of slots in a cycle, so the schedule repeats, and one cycle is all that is ever computed.
A source with one slot may stand anywhere in it, so only blocks of sources with several are
scheduled, and the others, of any number, fill the slots that are left. After t slots a source
has had less than one block more or less than w * t. A source that has run out leaves its slots
to the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exchange import partitions

SLOTS, BLOCK, SALTS = 200, 8, 256
#: Most blocks in a cycle that sources with several slots may have together; the default weights give no more than SLOTS.
MAX_BLOCKS = 10_000


def _salt(md5: Column) -> Column:
    return F.conv(F.substring(md5, 1, 2), 16, 10).cast("int")


def _ahead(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, salt, n) with how many there are under smaller salts."""
    return rows.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def quotas(counts: DataFrame, slots: int = SLOTS, power: float = 0.5) -> DataFrame:
    """(source, n, quota): slots of a cycle by largest remainder of n ** power; each source gets one at least, so a cycle may be longer than ``slots``.

    counts: (source, n), a row for each source. At most ``slots`` of them get more than one.
    """
    size = F.pow(F.col("n").cast("double"), F.lit(power)).cast("decimal(38,12)")  # exact sums in any order
    total = counts.agg(F.sum(size).cast("double")).scalar()
    w = counts.withColumn("share", size.cast("double") * slots / total).withColumn("whole", F.floor("share"))
    rest = F.round(F.col("share") - F.col("whole"), 9)
    first = w.select("source", rest.alias("rest")).orderBy(F.desc("rest"), "source").limit(slots)
    spare = w.agg(F.lit(slots) - F.sum("whole")).scalar()
    extra = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rest"), "source"))).where(F.col("rank") <= spare).select("source", F.lit(1).alias("extra"))
    return w.join(F.broadcast(extra), "source", "left").select("source", "n", F.greatest(F.col("whole") + F.coalesce("extra", F.lit(0)), F.lit(1)).cast("int").alias("quota"))


def cycle(weights: DataFrame) -> DataFrame:
    """(source, quota, cycle_slots, nth, slot): the slots of one cycle, numbered from 0, in which each source's nth block goes.

    weights: (source, quota). One row folds over the blocks of sources with several slots: of
    those whose next block is released, the one with the earliest deadline, ties to the first by
    name; where none is released the slot is left to sources with one, by the MD5 of their names.
    """
    several = F.col("quota") > 1
    pair = F.struct("source", "quota")
    one = weights.agg(F.coalesce(F.sum("quota"), F.lit(0)).cast("long").alias("cycle_slots"), F.coalesce(F.sum(F.when(several, F.col("quota"))), F.lit(0)).cast("int").alias("blocks"), F.array_sort(F.collect_list(F.when(several, pair))).alias("w"))
    one = one.withColumn("w", F.when(F.col("blocks") <= MAX_BLOCKS, F.col("w")).otherwise(F.raise_error(F.lit(f"more than {MAX_BLOCKS} blocks in a cycle; give coarser weights"))))
    plan = """
      if(blocks = 0, cast(array() as array<struct<slot:bigint,i:int,nth:int>>), aggregate(sequence(1, blocks),
        named_struct('t', cast(-1 as bigint), 'done', array_repeat(0, size(w)), 'order', cast(array() as array<struct<slot:bigint,i:int,nth:int>>)),
        (s, k) -> transform(array(transform(w, (x, i) -> named_struct('i', i, 'left', s.done[i] < x.quota,
              'release', (s.done[i] * cycle_slots) div x.quota, 'deadline', ((s.done[i] + 1) * cycle_slots + x.quota - 1) div x.quota))),
          c -> transform(array(greatest(s.t + 1, array_min(transform(filter(c, x -> x.left), x -> x.release)))),
            t -> transform(array(array_min(transform(filter(c, x -> x.left and x.release <= t), x -> named_struct('deadline', x.deadline, 'i', x.i))).i),
              p -> named_struct('t', t, 'done', transform(s.done, (d, i) -> if(i = p, d + 1, d)), 'order', concat(s.order, array(named_struct('slot', t, 'i', p, 'nth', s.done[p])))))[0])[0])[0],
        s -> s.order))"""
    # Both bounded by MAX_BLOCKS.
    one = one.select("w", "cycle_slots", F.expr(plan).alias("order"))
    heavy = one.select("w", "cycle_slots", F.explode("order").alias("o")).select(F.expr("w[o.i].source").alias("source"), F.expr("w[o.i].quota").alias("quota"), "cycle_slots", F.col("o.nth").alias("nth"), F.col("o.slot").alias("slot"))
    light = weights.where(~several).select("source", "quota", F.md5("source").alias("md5")).withColumn("salt", _salt(F.col("md5")))
    ahead = _ahead(light.groupBy("salt").agg(F.count(F.lit(1)).alias("n")), []).select("salt", "ahead")
    rank = F.row_number().over(Window.partitionBy("salt").orderBy("md5", "source")) + F.col("ahead") - 1
    light = light.join(F.broadcast(ahead), "salt").withColumn("r", rank).withColumn("cycle_slots", one.select("cycle_slots").scalar()).withColumn("taken", one.select(F.expr("transform(order, (o, j) -> o.slot - j)")).scalar())
    # The r-th free slot: the j-th taken one lies before it if at most r free ones precede that.
    light = light.select("source", "quota", "cycle_slots", F.lit(0).alias("nth"), (F.col("r") + F.size(F.filter("taken", lambda x: x <= F.col("r")))).cast("long").alias("slot"))
    return heavy.unionByName(light)


def mix(df: DataFrame, weights: DataFrame | None = None, slots: int = SLOTS, block: int = BLOCK, power: float = 0.5, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, target_weight, block, cycle, slot, position, deviation): each row's place in the mixture.

    position orders the whole mixture and has gaps only where a source has run out. deviation is
    what the source has had after its slot, less its due, in blocks, within the cycle: between -1
    and 1. weights: (source, quota); without it the quotas are those of ``quotas``. A null source
    is a source of its own; a source without a weight raises an error rather than lose its rows.
    Repeated rows each have a place; equal ids are in any order, a null id is first. No rows give
    none; other columns, long texts among them, aren't read. Sources may be of any number. Within
    a source the order is by the MD5 of the id, dealt out by its first byte: a source that holds
    a third of all rows is ranked in SALTS parts.
    """
    # Ids and sources alone move.
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"))
    rows = rows.withColumn("named", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).withColumn("md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("salt", _salt(F.col("md5")))
    parts = rows.groupBy("named", "salt").agg(F.count(F.lit(1)).alias("n"))  # SALTS rows a source
    if weights is None:
        weights = quotas(parts.groupBy(F.col("named").alias("source")).agg(F.sum("n").alias("n")), slots, power)
    else:
        weights = weights.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source"), F.col("quota").cast("int").alias("quota"))
    by_source = cycle(weights.select("source", "quota")).groupBy(F.col("source").alias("named")).agg(F.first("quota").alias("quota"), F.first("cycle_slots").alias("cycle_slots"), F.transform(F.sort_array(F.collect_list(F.struct("nth", "slot"))), lambda s: s["slot"]).alias("slots"))
    known = _ahead(parts, ["named"]).join(by_source, "named", "left").select("named", "salt", "ahead", F.coalesce("quota", F.raise_error(F.concat(F.lit("no weight for source "), F.col("named"))).cast("int")).alias("quota"), "cycle_slots", "slots")
    rank = F.row_number().over(Window.partitionBy("named", "salt").orderBy("md5", "doc_id"))
    placed = rows.withColumn("rank", rank).join(known, ["named", "salt"])
    placed = placed.withColumn("r", F.col("rank") + F.col("ahead") - 1).withColumn("block", F.expr(f"r div {block}")).withColumn("cycle", F.expr("block div quota")).withColumn("nth", (F.col("block") % F.col("quota")).cast("int"))
    placed = placed.withColumn("slot", F.expr("slots[nth]"))
    return placed.select(
        "doc_id", "source", (F.col("quota") / F.col("cycle_slots")).alias("target_weight"), "block", "cycle", "slot",
        ((F.col("cycle") * F.col("cycle_slots") + F.col("slot")) * block + F.col("r") % block).alias("position"),
        (F.col("nth") + 1 - (F.col("slot") + 1) * F.col("quota") / F.col("cycle_slots")).alias("deviation"),
    )


def interleaved(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of df themselves, whatever their columns' names, in the order of the mixture, dealt into ranges of it. Rows that share an id stand together at the first of their places."""
    places = mix(df.select(id_col, options.get("source_col", "source")), id_col=id_col, **options).groupBy("doc_id").agg(F.min("position").alias("position"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    joined = rows.join(places, F.col("id").eqNullSafe(F.col("doc_id")))
    return joined.repartitionByRange(partitions(df.sparkSession), "position").sortWithinPartitions("position").select("row.*")
