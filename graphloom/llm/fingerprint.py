"""Homomorphic multiset fingerprints of documents, with DataFrame functions alone.

A text is the multiset of its paragraphs (lines, cut at sentence ends). Each paragraph hashes to
a wide vector: plus or minus 1 in each of 124 signed lanes (modulo 2**32) and a value in each of 4
dense lanes (modulo 2**48). A fingerprint is the sum: order doesn't matter, and a paragraph is
inserted or deleted by adding or subtracting its vector. Equal fingerprints are a matter of all
lanes. Likeness comes from the signed ones: the squared distance of two sums estimates the
paragraphs that one text has and the other hasn't, their squared norms estimate all paragraphs.
It holds for texts of fewer than 2**31 paragraphs, with an error of about a tenth; a paragraph
weighs by the square of its repetitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exchange import partitions

#: Lanes of one hash: bits 0 to 61, two to a sum, 31 bits apart.
HALF = 31
HASHES, DENSE = 2, 4
SIGNED = HASHES * 2 * HALF
_SHORT, _WIDE, _LIMB = (1 << 32) - 1, (1 << 48) - 1, 24


def paragraphs(text: Column) -> Column:
    """Non-empty paragraphs, each hashed once; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[.!?])\s+")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p))


def _word(h: Column, g: int | Column) -> Column:
    """The hash whose bits are the signs of lanes 2 * HALF * g and following."""
    return F.xxhash64(h, F.lit(100) + g if isinstance(g, Column) else F.lit(100 + g))


def _dense(h: Column, k: int) -> Column:
    return F.xxhash64(h, F.lit(k)).bitwiseAND(F.lit(_WIDE))


def vector(p: Column) -> Column:
    """array<bigint> of SIGNED + DENSE lanes, from a column of ``paragraphs``: for paragraphs to insert or delete. Whole tables are quicker by ``sums``."""
    ones = F.transform(F.sequence(F.lit(0), F.lit(SIGNED - 1)), lambda j: F.aggregate(p, F.lit(0).cast("bigint"), lambda acc, h: acc + F.getbit(_word(h, F.floor(j / (2 * HALF)).cast("int")), (j % (2 * HALF)).cast("int"))))
    signed = F.transform(ones, lambda c: (2 * c - F.size(p)).bitwiseAND(F.lit(_SHORT)))

    def lane(k: int) -> Column:
        return F.aggregate(p, F.lit(0).cast("bigint"), lambda acc, h: (acc + _dense(h, k)).bitwiseAND(F.lit(_WIDE)))

    return F.concat(signed, F.array(*map(lane, range(DENSE))))


def sums(h: Column) -> list[Column]:
    """Aggregates over exploded paragraphs (null for a text without any), from which ``vector_of`` makes the vector: no sum can overflow below 2**31 paragraphs."""
    two = (1 << HALF) | 1
    total = lambda c: F.sum(F.when(h.isNotNull(), c))
    out = [F.count(h).alias("n")]
    out += [total(F.shiftrightunsigned(_word(h, g), k).bitwiseAND(F.lit(two))).alias(f"s{g}_{k}") for g in range(HASHES) for k in range(HALF)]
    out += [total(F.shiftrightunsigned(_dense(h, k), _LIMB * i).bitwiseAND(F.lit((1 << _LIMB) - 1))).alias(f"d{k}_{i}") for k in range(DENSE) for i in (0, 1)]
    return out


def vector_of() -> Column:
    """The vector of a row of ``sums``."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    low, high = (lambda c: c.bitwiseAND(F.lit((1 << HALF) - 1))), (lambda c: F.shiftright(c, HALF))
    ones = F.array(*(half(zero(f"s{g}_{k}")) for g in range(HASHES) for half in (low, high) for k in range(HALF)))
    signed = F.transform(ones, lambda c: (2 * c - F.col("n")).bitwiseAND(F.lit(_SHORT)))
    dense = [(zero(f"d{k}_0") + F.shiftleft(zero(f"d{k}_1").bitwiseAND(F.lit((1 << _LIMB) - 1)), _LIMB)).bitwiseAND(F.lit(_WIDE)) for k in range(DENSE)]
    return F.concat(signed, F.array(*dense))


def encode(v: Column) -> Column:
    """Hexadecimal text of a vector: 8 digits for each signed lane, 12 for each dense one."""
    return F.array_join(F.transform(v, lambda x, i: F.lower(F.lpad(F.hex(x), F.when(i < SIGNED, 8).otherwise(12), "0"))), "")


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of the union of two multisets (sign 1), or of what is left without b's paragraphs (sign -1)."""
    return F.zip_with(
        F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), b,
        lambda s, y: F.when(s["i"] < SIGNED, (s["x"] + sign * y).bitwiseAND(F.lit(_SHORT))).otherwise((s["x"] + sign * y).bitwiseAND(F.lit(_WIDE))),
    )


def likeness(a: Column, b: Column) -> Column:
    """Of all paragraphs of two texts, the share that both have, as their vectors tell it: 1 for equal vectors, below 1 for others, 0 at least."""
    whole = lambda x: ((x + (1 << 31)).bitwiseAND(F.lit(_SHORT)) - (1 << 31)).cast("double")
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + whole(x) * whole(x))
    x, y = F.slice(a, 1, SIGNED), F.slice(b, 1, SIGNED)
    apart = square(F.zip_with(x, y, lambda p, q: p - q))
    near = 1 - apart / F.greatest(square(x) + square(y), F.lit(1.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(near, F.lit(1.0 - 1 / 1024))))


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range, place, doc_id, text, guest, next_text): the text of the document with the next smaller id, for the smallest the greatest's.

    The rows are dealt into ranges of ids, and each range gets its neighbour's greatest row as a
    guest, so no task holds more than a range. Equal ids follow each other in the order of their
    texts; a null id comes after all others. place numbers the rows of a range in that order.
    """
    n = partitions(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = [i / n for i in range(1, n)] or [0.5]
    # n - 1 numbers, whatever the input
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("c")).first()["c"] or []))
    inner = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + inner] for i in range(0, len(cuts), inner)]
    if groups:
        heads = F.array(*(F.lit(g[0]) for g in groups))
        table = F.array(*(F.array(*(F.lit(x) for x in g)) for g in groups))
        above = F.size(F.filter(heads, lambda c: c <= F.col("doc_id")))
        place = F.when(above > 0, (above - 1) * inner + F.size(F.filter(F.element_at(table, F.greatest(above, F.lit(1))), lambda c: c <= F.col("doc_id")))).otherwise(0)
    else:
        place = F.lit(0)
    docs = docs.withColumn("range", F.coalesce(place, F.lit(-1)).cast("int"))
    # The greatest id of each range: n rows at most. Of several texts with it the first is the guest.
    tops = docs.groupBy("range").agg(F.max("doc_id").alias("top"), F.lit(1).alias("one"))
    everything = Window.partitionBy("one")
    tops = tops.withColumn("to", F.coalesce(F.lead("range").over(everything.orderBy("range")), F.min("range").over(everything)))
    guests = docs.join(F.broadcast(tops.select(F.col("range").alias("r"), "top", "to")), (F.col("range") == F.col("r")) & F.col("top").eqNullSafe(F.col("doc_id")))
    guests = guests.groupBy(F.col("to").alias("range")).agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"), F.lit(True).alias("guest"))
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    rows = docs.withColumn("guest", F.lit(False)).unionByName(guests)
    return rows.select("range", F.row_number().over(order).alias("place"), "doc_id", "text", "guest", F.lead("text").over(order).alias("next_text"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, whose last half is the beginning of the next document's.

    Null text is empty: no paragraphs, the zero vector. Repeated rows each give a row, equal ids
    in the order of their texts; a single document is its own next. No rows give none; other
    columns are ignored. A text is handled whole, whatever its length; its paragraphs are added
    up one by one.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(df, id_col, text_col).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    key = ["range", "place", "doc_id", "guest", "n_chars", "edited_sha256", "side"]
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("said")), F.struct(F.lit(1).alias("side"), F.when(~F.col("guest"), F.col("edited")).alias("said")))
    rows = rows.select("range", "place", "doc_id", "guest", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(sides).alias("s"))
    rows = rows.select(*key[:-1], "s.side", F.explode_outer(paragraphs(F.col("s.said"))).alias("h"))
    # Rows of one range are in one task, so neither the sums nor what follows moves a row.
    rows = rows.groupBy(*key).agg(*sums(F.col("h"))).select(*key, vector_of().alias("v"))
    order = Window.partitionBy("range").orderBy("place", "side")
    rows = rows.withColumn("b", F.lead("v", 1).over(order)).withColumn("c", F.lead("v", 2).over(order)).where("side = 0 and not guest")
    return rows.select("doc_id", "n_chars", "edited_sha256", encode(F.col("v")).alias("fingerprint"), encode(F.col("b")).alias("edited_fingerprint"), likeness(F.col("v"), F.col("b")).alias("near_edited"), likeness(F.col("v"), F.col("c")).alias("near_next"))
