"""Preference formatting: the prompt that chosen and rejected conversations share, and two masked completions.

Turns stay rows, so no conversation is ever gathered into one; a long one is dealt out by ranges of
CHUNK turns. Texts move once: ranges tell where they first differ and how long they are, and what
all ranges of a pair say together comes back to the turns as a few numbers a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns of a conversation that one task handles together, as a power of two.
CHUNK_BITS = 6
_RANGE = ["pk", "pn", "ck", "cn"]


def _header(side: Column) -> Column:
    return F.concat(F.lit(OPEN), side["role"], F.lit("\n"))


def _rendered(side: Column) -> Column:
    return F.concat(_header(side), side["text"], F.lit(CLOSE + "\n"))


def _size(side: Column) -> Column:
    return F.coalesce(F.length(_rendered(side)), F.lit(0)).cast("long")


def preference_turns(chosen: DataFrame, rejected: DataFrame, edits: bool = False, pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn of a pair: (pair_id, turn, part, prompt, prompt_start, chosen, chosen_start, chosen_loss_start, chosen_loss_length, and the same of rejected).

    part is ``prompt`` for the longest run of first turns that both sides have alike, rendered
    once; ``completion`` for all that follows, both sides beside each other. The starts are
    places in the prompt or in the side's completion, in characters, when its turns are joined in
    their order. Loss spans cover what assistant turns of a completion say, with the closing
    mark; they are null for all else. With ``edits`` rejected holds only the turns that differ
    from chosen. Of several rows for a turn the first by role and text stays; null role is
    'user', null text empty. A pair that lacks a side has an empty prompt; rows with a null pair
    or turn are turns of the null pair or before the first turn. Sides that are alike are all
    prompt. No rows give none; other columns are ignored. Turns and texts may be of any number
    and length; a single turn is handled whole. Control strings inside a text are not escaped.
    """
    said = F.struct(F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    side = lambda df, name: df.select(F.col(pair_col).cast("long").alias("pair_id"), F.col(turn_col).cast("long").alias("turn"), said.alias(name))
    rows = side(chosen, "chosen").unionByName(side(rejected, "other"), allowMissingColumns=True).withColumn("chunk", F.shiftright("turn", CHUNK_BITS))
    keys = [F.coalesce("pair_id", F.lit(0)).alias("pk"), F.col("pair_id").isNull().alias("pn"), F.coalesce("chunk", F.lit(0)).alias("ck"), F.col("chunk").isNull().alias("cn")]
    rows = rows.select(*keys, "pair_id", "turn", "chosen", "other").repartition(*_RANGE)
    turns = rows.groupBy(*_RANGE, "pair_id", "turn").agg(F.min("chosen").alias("chosen"), F.min("other").alias("other"))
    turns = turns.withColumn("rejected", F.coalesce("other", "chosen") if edits else F.col("other")).drop("other")

    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    whole = Window.partitionBy(*_RANGE)
    so_far = whole.orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("place", place).withColumn("first", F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("place"))).over(whole))
    own = F.col("first").isNotNull() & (F.col("place") >= F.col("first"))  # from the range's own first difference on
    for name, tail in (("chosen", "c"), ("rejected", "r")):
        turns = turns.withColumn(f"all_{tail}", F.sum(_size(F.col(name))).over(so_far)).withColumn(f"own_{tail}", F.sum(F.when(own, _size(F.col(name))).otherwise(0)).over(so_far))

    # A row for each range.
    sums = turns.groupBy(*_RANGE).agg(F.min("first").alias("own_first"), *(F.max(f"{k}_{t}").alias(f"{k}_{t}") for k in ("all", "own") for t in "cr"))
    pair = Window.partitionBy("pk", "pn")
    before = pair.orderBy(F.col("cn").desc(), "ck").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("pair_first", F.min("own_first").over(pair)).withColumn("starts", F.col("own_first").isNotNull() & (F.col("own_first") == F.col("pair_first")))
    sums = sums.withColumn("started", F.coalesce(F.max("starts").over(before), F.lit(False)))
    for t in "cr":
        part = F.when(F.col("started"), F.col(f"all_{t}")).when(F.col("starts"), F.col(f"own_{t}")).otherwise(0)
        sums = sums.withColumn(f"part_{t}", part).withColumn(f"ahead_{t}", F.coalesce(F.sum(f"part_{t}").over(before), F.lit(0)))
    sums = sums.withColumn("ahead_p", F.coalesce(F.sum("all_c").over(before), F.lit(0)))
    sums = sums.select(*_RANGE, "pair_first", "started", "ahead_c", "ahead_r", "ahead_p").repartition(*_RANGE)

    out = turns.join(sums, _RANGE)
    prompt = F.col("pair_first").isNull() | (F.col("place") < F.col("pair_first"))
    columns = ["pair_id", "turn", F.when(prompt, "prompt").otherwise("completion").alias("part"), F.when(prompt, _rendered(F.col("chosen"))).alias("prompt"), F.when(prompt, F.col("ahead_p") + F.col("all_c") - _size(F.col("chosen"))).alias("prompt_start")]
    for name, t in (("chosen", "c"), ("rejected", "r")):
        said = F.col(name)
        shown = ~prompt & said.isNotNull()
        start = F.col(f"ahead_{t}") + F.when(F.col("started"), F.col(f"all_{t}")).otherwise(F.col(f"own_{t}")) - _size(said)
        loss = shown & (said["role"] == "assistant")
        columns += [
            F.when(shown, _rendered(said)).alias(name), F.when(shown, start).alias(f"{name}_start"),
            F.when(loss, start + F.length(_header(said))).alias(f"{name}_loss_start"), F.when(loss, (F.length(said["text"]) + len(CLOSE)).cast("long")).alias(f"{name}_loss_length"),
        ]
    return out.select(*columns)


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_loss, rejected_loss): a row for each pair of ``preference_turns``, for conversations that fit into one; the loss columns are (start, length) spans of the completions."""
    got = turns.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("at"), *(c for c in turns.columns if c != "pair_id")))).alias("t"))
    text = lambda c: F.array_join(F.transform("t", lambda s: s[c]), "").alias(c)
    loss = lambda c: F.transform(F.filter("t", lambda s: s[f"{c}_loss_start"].isNotNull()), lambda s: F.struct(s[f"{c}_loss_start"].alias("start"), s[f"{c}_loss_length"].alias("length"))).alias(f"{c}_loss")
    return got.select("pair_id", text("prompt"), text("chosen"), text("rejected"), loss("chosen"), loss("rejected"))


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): for conversations without a rejected side, what their last assistant turn says there: the neighbour's (conv_id with its last bit turned) last reply, or nothing without one.

    Conversations without an assistant turn, and null ones, have no such row. Of equal turns the
    greatest text is the reply. Other columns are ignored; no rows give none.
    """
    reply = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    odd = F.col("conv_id").bitwiseAND(F.lit(1)) == 1
    said = conversations.where((F.col("role") == "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    two = said.groupBy(F.shiftright(F.col("conv_id").cast("long"), 1).alias("k")).agg(F.max(F.when(~odd, reply)).alias("even"), F.max(F.when(odd, reply)).alias("odd"))
    edit = lambda bit, own, other: F.struct((F.col("k") * 2 + bit).alias("conv_id"), F.col(own)["turn"].alias("turn"), F.coalesce(F.col(other)["text"], F.lit("")).alias("text"))
    edits = two.select(F.explode(F.array(edit(0, "even", "odd"), edit(1, "odd", "even"))).alias("e")).where("e.turn is not null")
    return edits.select("e.conv_id", "e.turn", F.lit("assistant").alias("role"), "e.text")
