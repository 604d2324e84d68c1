"""Conversation structure repair: the cheapest edits that make turns alternate, by a DP over the turns that are kept.

A conversation may be of any length. Rows are ranged by conversation and turn, and what one range
holds of a conversation is a chunk. A chunk of a conversation that goes over a border gives its
best edits from each state it may be entered in to each it may be left in; these few numbers are
folded along the conversation, and a choice of edits for each chunk comes back. Only the digest of
a repaired conversation follows its turns one after the other, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytescan import lean_task
from .exchange import partitions, stored

#: Costs of edits, and of leaving a truncated turn in.
DELETE, INSERT, REROLE, LEFT_TRUNCATED = 2, 5, 1, 5
#: States after the last kept turn: none yet, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_TAIL = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_ROLE = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: What may follow: (state before, state after) -> turns to insert between them.
_GAP = {(NONE, SYSTEM): 0, (NONE, USER): 0, (NONE, ASSISTANT): 1, (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): 1, (USER, USER): 1, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): 1}
_BEFORE = {after: [(before, n) for (before, a), n in _GAP.items() if a == after] for after in (SYSTEM, USER, ASSISTANT)}
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3
_FAR = 1 << 60


def text_or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes its role user.

    Null roles and texts become one space, and null ids and turns count as one in the key, so the
    rows of a null id are damaged too. Rows of one id and turn share their damage. Other columns
    go. No rows give none.
    """
    kind = F.crc32(F.concat(text_or_space("conv_id"), F.lit(":"), text_or_space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_or_space("role").alias("role"), text_or_space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    once = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return once.drop("copy")


class Walk:
    """The best edits from one state, turn by turn.

    Per state it has the least cost less the deletions of all turns so far (a running minimum: turns
    that are deleted don't change it) and the place of its edits among those of all states in ASCII
    order. Two states never have the same edits, and none's are the beginning of another's, as
    each turn gives one letter besides inserts and edits end with a turn's letter. So places and
    the letters added last decide every tie.
    """

    def __init__(self, start: int):
        self.low, self.place, self.turns = [_FAR] * 4, list(range(4)), 0
        self.low[start] = 0
        self.choices: list[tuple] = []

    def step(self, initial: str, fault: int) -> None:
        """One more turn."""
        self.turns += 1
        best = [(self.low[q], self.place[q], "D", q) for q in range(4)]
        if fault not in (_BLANK, _DUPLICATE):
            own, extra = _INITIAL.get(initial), (LEFT_TRUNCATED if fault == _TRUNCATED else 0) - DELETE
            for after, befores in _BEFORE.items():
                if after == own:
                    letter, cost = "K", extra
                elif after == SYSTEM:
                    continue
                else:
                    letter, cost = "R", extra + REROLE
                for before, n in befores:
                    if self.low[before] < _FAR:
                        best[after] = min(best[after], (self.low[before] + cost + n * INSERT, self.place[before], "I" * n + letter, before))
        self.low = [b[0] for b in best]
        order = sorted(range(4), key=lambda q: best[q][1:3])
        for i, q in enumerate(order):
            self.place[q] = i
        self.choices.append(tuple(b[2:] for b in best))

    def cost(self, q: int) -> int:
        return self.low[q] + DELETE * self.turns

    def reached(self) -> list[int]:
        return [q for q in range(4) if self.low[q] < _FAR]

    def edits(self, q: int) -> str:
        letters = []
        for choice in reversed(self.choices):
            added, q = choice[q]
            letters.append(added)
        return "".join(reversed(letters))


def ending(ways: Iterable[tuple[int, int, int]]) -> tuple[int, int]:
    """(cost with the turns to append, state) of the best of (state, cost, place) ways to leave."""
    return min(((cost + INSERT * len(_TAIL[q]), place, q) for q, cost, place in ways))[::2]


def applied(letters: str, state: int, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str, int]]:
    """(edit, role, text, state) of the turns that edits make of (role, text) turns; an edit K keeps the turn's own role."""
    rows = iter(turns)
    for letter in letters:
        if letter == "D":
            next(rows)
            continue
        role, text = ("", "") if letter == "I" else next(rows)
        state = SYSTEM if letter == "K" and state == NONE and role[:1] == "s" else ASSISTANT if state == USER else USER
        yield letter, role if letter == "K" else _ROLE[state], text, state


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of a sorted stream in groups of the same first columns; a group is a stream too."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, lambda r: r[:keys])


_KEYS = ["ck", "cn"]
_CHUNK = ["ck", "cn", "part"]
_SUMMARY = "ck long, cn boolean, part long, spans boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, ways array<struct<enter: int, leave: int, cost: long, place: int, letters: string>>"
_SUMMARY_ARROW = pa.schema([
    ("ck", pa.int64()), ("cn", pa.bool_()), ("part", pa.int64()), ("spans", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
    ("ways", pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("place", pa.int32()), ("letters", pa.string())]))),
])
_LEGAL = {"su", "ua", "au"}


def _summary(rows: Iterator[tuple]) -> tuple:
    """One chunk: counts, and the ways through it. A row without initial names a text that an earlier chunk has."""
    walks, seen, counts, illegal, first, last, low, high, turns, spans = [], set(), [0] * 4, 0, None, None, None, None, 0, False
    for *_, spans, later, turn, digest, initial, fault in rows:
        if not walks:
            walks = [Walk(q) for q in (range(4) if later else (NONE,))]
        if initial is None:
            seen.add(digest)
            continue
        if fault != _BLANK and digest in seen:
            fault = _DUPLICATE
        seen.add(digest)
        counts[fault] += 1
        if last is None:
            first = initial
        elif last + initial not in _LEGAL:
            illegal += 1
        last = initial
        if turn is not None and turn != high:
            low, high, turns = (turn if low is None else low), turn, turns + 1
        for w in walks:
            w.step(initial, fault)
    if spans:
        ways = [dict(enter=e, leave=q, cost=w.cost(q), place=w.place[q], letters=w.edits(q)) for w in walks for e in [next(s for s in range(4) if w is walks[s])] for q in w.reached()]
    else:
        w = walks[0]
        cost, q = ending((q, w.cost(q), w.place[q]) for q in w.reached())
        ways = [dict(enter=NONE, leave=q, cost=cost, place=0, letters=w.edits(q) + _TAIL[q])]
    return spans, counts[_BLANK], counts[_DUPLICATE], counts[_TRUNCATED], illegal, first, last, low, high, turns, ways


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for key, rows in _runs(batches, 3):
        out.append((*key, *_summary(rows)))
        if len(out) == 512:
            yield _batch(out, _SUMMARY_ARROW)
            out = []
    if out:
        yield _batch(out, _SUMMARY_ARROW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _folded(chunks: pd.DataFrame) -> pd.DataFrame:
    """All chunks of a conversation that goes over borders, as many as it has ranges at most: the way through each, and what they come to."""
    chunks = chunks.sort_values("part")
    front, back = {NONE: (0, 0)}, []
    for ways in chunks["ways"]:
        best: dict[int, tuple] = {}
        for w in ways:
            if w["enter"] in front:
                cost, place = front[w["enter"]]
                best[w["leave"]] = min(best.get(w["leave"], (_FAR,)), (cost + w["cost"], place, w["place"], w["enter"]))
        order = sorted(best, key=lambda q: best[q][1:3])
        front = {q: (best[q][0], order.index(q)) for q in best}
        back.append({q: b[3] for q, b in best.items()})
    cost, q = ending((q, *f) for q, f in front.items())
    path, tail = [], _TAIL[q]
    for step in reversed(back):
        path.append((step[q], q))
        q = step[q]
    path.reverse()
    first, last, low, high = (chunks[c].tolist() for c in ("first", "last", "low", "high"))
    known = [(a, b) for a, b in zip(low, high) if not pd.isna(a)]
    turns = int(chunks["turns"].sum()) - sum(a[1] == b[0] for a, b in zip(known, known[1:]))
    illegal = int(chunks["illegal"].sum()) + sum(a + b not in _LEGAL for a, b in zip(last, first[1:]))
    gaps = int(known[-1][1] - known[0][0] + 1 - turns) if known else 0
    return pd.DataFrame({
        "ck": chunks["ck"], "cn": chunks["cn"], "part": chunks["part"], "enter": [p[0] for p in path], "leave": [p[1] for p in path], "tail": [""] * (len(path) - 1) + [tail],
        "gaps": gaps, "blank": int(chunks["blank"].sum()), "duplicate": int(chunks["duplicate"].sum()), "truncated": int(chunks["truncated"].sum()), "illegal": illegal, "cost": int(cost),
    })


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def ranged(conversations: DataFrame) -> DataFrame:
    """Stored rows in order: (ck, cn, conv_id, part, seq, turn, role, text); seq ascends along conversations and their turns, part names the range."""
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("ck"), F.col("conv_id").isNull().alias("cn"), F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"), text_or_space("role").alias("role"), text_or_space("text").alias("text"),
    )
    order = [F.col("cn"), F.col("ck"), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.repartitionByRange(partitions(conversations.sparkSession), *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    return stored(dealt.select("*", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("seq")), "turns")


def plans(rows: DataFrame) -> DataFrame:
    """Stored (ck, cn, part, enter, letters, gaps, blank, duplicate, truncated, illegal, cost): a row for each chunk of ``ranged`` rows; the counts are the whole conversation's."""
    # One conversation at most goes over each border, so there are fewer of these than ranges.
    spans = stored(rows.groupBy(*_KEYS).agg(F.min("part").alias("head"), F.max("part").alias("foot")).where("head < foot"), "spanning")
    said = F.unhex(F.md5(F.concat("role", F.lit("\0"), "text")))
    shown = "[^\\x20\\x09-\\x0D]"
    fault = F.when(~F.col("text").rlike(shown), _BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), _TRUNCATED).otherwise(0)
    light = rows.select(*_CHUNK, "seq", "turn", said.alias("digest"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault")).join(F.broadcast(spans), _KEYS, "left")
    light = light.withColumn("spans", F.col("head").isNotNull()).withColumn("later", F.coalesce(F.col("part") > F.col("head"), F.lit(False)))

    # Texts of spanning conversations that an earlier chunk has, to stand before a chunk's rows.
    held = light.where("spans").select(*_CHUNK, "digest").distinct()
    known = held.withColumn("earliest", F.min("part").over(Window.partitionBy(*_KEYS, "digest"))).where("part > earliest")
    markers = known.select(*_CHUNK, F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("spans"), F.lit(True).alias("later"), F.lit(None).cast("long").alias("turn"), "digest", F.lit(None).cast("string").alias("initial"), F.lit(0).alias("fault"))
    columns = [*_CHUNK, "seq", "spans", "later", "turn", "digest", "initial", "fault"]
    lined = light.select(*columns).unionByName(markers.select(*columns)).repartition(partitions(rows.sparkSession), *_CHUNK).sortWithinPartitions(*_CHUNK, "seq")
    chunks = stored(lined.mapInArrow(lean_task(_chunks), _SUMMARY), "chunks")

    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long")
    whole = chunks.where("not spans").select(*_CHUNK, F.lit(NONE).alias("enter"), F.col("ways")[0]["letters"].alias("letters"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("ways")[0]["cost"].alias("cost"))
    light_ways = F.transform("ways", lambda w: F.struct(w["enter"].alias("enter"), w["leave"].alias("leave"), w["cost"].alias("cost"), w["place"].alias("place")))
    parts = chunks.where("spans")
    fold = parts.withColumn("ways", light_ways).drop("spans").groupBy(*_KEYS).applyInPandas(_folded, "ck long, cn boolean, part long, enter int, leave int, tail string, " + ", ".join(f"{c} long" for c in _REPORT))
    chosen = F.filter("ways", lambda w: (w["enter"] == F.col("enter")) & (w["leave"] == F.col("leave")))[0]["letters"]
    pieces = parts.select(*_CHUNK, "ways").join(fold, _CHUNK).select(*_CHUNK, "enter", F.concat(chosen, "tail").alias("letters"), *_REPORT)
    return stored(whole.unionByName(pieces), "plans")


def _told(rows: DataFrame, plan: DataFrame, *keys: str, originals: DataFrame | None = None) -> DataFrame:
    """Rows in order, each chunk's plan before its turns, and an empty row for each original conversation."""
    turns = rows.select(*_CHUNK, "seq", "role", "text", *(F.lit(None).cast(t).alias(c) for c, t in (("enter", "int"), ("letters", "string"))), *(F.lit(None).cast("long").alias(c) for c in _REPORT))
    heads = plan.select(*_CHUNK, F.lit(-1).cast("long").alias("seq"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text")), "enter", "letters", *_REPORT)
    told = turns.unionByName(heads)
    if originals is not None:
        ids = originals.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("ck"), F.col("conv_id").isNull().alias("cn")).distinct()
        told = told.unionByName(ids.select("ck", "cn", *(F.lit(-1).cast("long").alias(c) for c in ("part", "seq"))), allowMissingColumns=True)
    return told.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*_CHUNK, "seq")


_TURNS = pa.schema([("ck", pa.int64()), ("cn", pa.bool_()), ("part", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for key, rows in _runs(batches, 3):
        _, _, _, _, _, _, enter, letters, *_ = next(rows)
        for i, (edit, role, text, _) in enumerate(applied(letters, enter, ((r[4], r[5]) for r in rows))):
            out.append((*key, i, edit, role, text))
            size += len(text)
            if size > 1 << 20 or len(out) == 4096:
                yield _batch(out, _TURNS)
                out, size = [], 0
    if out:
        yield _batch(out, _TURNS)


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, place, edit, role, text): the turns of repaired conversations, ordered by part and place inside one; edit is K, R or I. Odd cases as in ``repair_reports``."""
    rows = ranged(conversations)
    made = _told(rows, plans(rows), *_CHUNK).mapInArrow(lean_task(_apply), "ck long, cn boolean, part long, place long, edit string, role string, text string")
    return made.select(F.when(~F.col("cn"), F.col("ck")).alias("conv_id"), "part", "place", "edit", "role", "text")


_DIGESTS = pa.schema([("ck", pa.int64()), ("cn", pa.bool_()), *((c, pa.int64()) for c in _REPORT), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for key, rows in _runs(batches, 2):
        report, audit, said, first = [0] * len(_REPORT), [], hashlib.sha256(), True
        for _, chunk in groupby(rows, lambda r: r[2]):
            head = next(chunk)
            if head[7] is None:  # stands for a conversation that may have no rows
                continue
            report = head[8:]
            audit.append(head[7])
            for _, role, text, _ in applied(head[7], head[6], ((r[4], r[5]) for r in chunk)):
                said.update((role + ":" + text if first else "\n" + role + ":" + text).encode())
                first = False
        out.append((*key, *report, "".join(audit), said.hexdigest()))
        if len(out) == 512:
            yield _batch(out, _DIGESTS)
            out = []
    if out:
        yield _batch(out, _DIGESTS)


def repair_reports(conversations: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row for each conv_id of conversations, and of ``originals``.

    Turns are taken in the order of turn (nulls first), role, text. A turn is blank (no text but
    white space), else a duplicate (its role and text stand earlier), else truncated (doesn't end
    in ``.!?``). Edits cost nothing for K(eep), 1 for R(erole) to user or assistant, 2 for
    D(elete), which blank and duplicate turns need, and 5 for I(nsert) of an empty user or
    assistant turn; a truncated turn that stays adds 5. audit has the letters of the cheapest
    edits after which the initials of roles are ``(s?(ua)+)?``, the least in ASCII order of
    several. gaps counts the whole numbers missing between the least and the greatest turn. Null
    roles and texts are one space, so a turn without text is blank and one without role can't be kept as it
    is; rows of a null conv_id are one conversation. Without rows: zeros, no edits, the digest of
    nothing. Rows that are alike are duplicates. Texts and conversations may be of any length,
    the audit and the digest follow a conversation as a stream of turns. Other columns are ignored.
    """
    rows = ranged(conversations)
    told = _told(rows, plans(rows), *_KEYS, originals=originals)
    made = told.mapInArrow(lean_task(_digest), "ck long, cn boolean, " + ", ".join(f"{c} long" for c in _REPORT) + ", audit string, repaired_sha256 string")
    return made.select(F.when(~F.col("cn"), F.col("ck")).alias("conv_id"), *_REPORT, "audit", "repaired_sha256")
