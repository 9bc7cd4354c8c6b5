"""Damage to conversations, and the cheapest edits that repair their structure.

A conversation's rows become a signature, one letter a row: the role's initial
and whether the row must go (blank or duplicate) or is truncated.  The edits
that make ``(s?(ua)+)?`` of a signature depend on nothing else, so equal
signatures are solved once, and so are equal endings:

1. Narrow rows (no texts) are collapsed by content; a row is the first of its
   content where its turn is the least one, found by a combining aggregate.
2. They are range-partitioned by conversation and turn, and each task streams
   its range into pieces of signatures; the few pieces of a conversation that
   spans several ranges are put together in order.
3. Distinct signatures are range-partitioned by their reverse.  Read that way,
   signatures with equal endings are neighbours: the automaton that shares all
   endings is walked depth first, its current path is a stack, and each node's
   cost-to-go and first edit for each of the four grammar states are computed
   when it is pushed, once (a path cut by the border of a range: once on each
   side).
4. Signatures carry their edits back to the conversations, and each
   conversation's rows follow its edits in one sorted stream, which hashes the
   repaired rows as they pass.

What one task holds of a conversation is its signature and its edits, one byte
a row, both of the size of its result row; texts stream.

Ties: every edit of a state has a letter of its own, so the ASCII-least of the
cheapest edits takes the least letter first, and no strings are compared.

Defined results: nulls count as one space (a null text is blank, a null role
has the initial space, which the grammar never keeps); rows of one turn follow
one another by role and by the text's hash; equal rows are duplicates; the null
conversation is one; conversations whose rows are all dropped have zeros, empty
edits and the hash of nothing; texts of any length are read whole; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.workspace import Workspace, bounded_batches, partitions

#: White space, and what ends a whole text.
SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Fixed values of the contract: costs of the edits.
RETURN, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Grammar states: nothing yet, after the system's row, after a user's, after an assistant's.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The row that each state expects next (both by keeping and by making one) and the state after it.
NEXT = {NOTHING: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLE = {"u": "user", "a": "assistant"}
#: Letters of a signature: rows as they are, truncated rows, rows that must go; and of the path through the automaton.
PLAIN, TRUNCATED, GONE = "suao", "SUAO", "wxyz"
NEVER = 1 << 40


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by the crc32 of ``conv_id:turn``."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(said("text"), ENDS, "")).otherwise(said("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(said("role"))
    out = rows.withColumn("kind", kind).filter("kind <> 0").select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), "kind")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def flagged(rows: DataFrame) -> DataFrame:
    """One row for each different (conv_id, turn, role, text): how often it is
    there, its fault and initial, and whether its content is first seen here."""
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(end == "", "blank").when(F.instr(F.lit(ENDS), F.right(end, F.lit(1))) > 0, "none").otherwise("truncated")
    initial = F.left("role", F.lit(1))
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), fault.alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"))
    same = ["conv_id", "turn", "role", "digest"]
    counted = narrow.groupBy(*same).agg(F.count("*").alias("times"), F.first("fault").alias("fault"), F.first("initial").alias("initial"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = narrow.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("least"))
    first = first.select(F.col("conv_id").alias("c"), F.col("least.turn").alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"))
    meets = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return counted.join(first, meets, "left").select(*same, "times", "fault", "initial", F.col("r").isNotNull().alias("first"))


def _letters(fault: str, initial: str, first: bool, times: int) -> str:
    k = PLAIN.index(initial)
    if fault == "blank":
        return GONE[k] * times
    lead = GONE[k] if not first else (TRUNCATED if fault == "truncated" else PLAIN)[k]
    return lead + GONE[k] * (times - 1)


_PIECE = "conv_id long, turn long, letters string, blank long, duplicate long, truncated long, turns long, low long, high long"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range of flagged rows -> one row for each conversation in it."""
    names = [x.split()[0] for x in _PIECE.split(", ")]
    types = [pa.string() if n == "letters" else pa.int64() for n in names]
    made: list[tuple] = []
    now = None

    def whole() -> tuple:
        return (*now[:2], "".join(now[2]), *now[3:])

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for conv, turn, times, fault, initial, first in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if now is None or now[0] != conv:
                if now:
                    made.append(whole())
                now = [conv, turn, [], 0, 0, 0, 0, None, None]
            now[2].append(_letters(fault, initial, first, times))
            if fault == "blank":
                now[3] += times
            else:
                now[4] += times - first
                now[5] += fault == "truncated" and first
            if turn is not None:
                now[6] += turn != now[8]
                now[7] = turn if now[7] is None else now[7]
                now[8] = turn
        if made:
            yield table()
            made.clear()
    if now:
        made.append(whole())
        yield table()


def signatures(rows: DataFrame, ws: Workspace) -> DataFrame:
    """(conv_id, letters, and the counts of faults and gaps) of each conversation."""
    flags = ws.keep(flagged(rows), "flags")  # written, so that sampling for ranges does not repeat the aggregates
    parted = flags.repartitionByRange(partitions(flags.sparkSession), F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()).sortWithinPartitions(*_order())
    parts = parted.select("conv_id", "turn", "times", "fault", "initial", "first").mapInArrow(pieces, _PIECE)
    # At most one piece for each range that a conversation spans.
    in_order = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "letters")))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "turns")]
    whole = parts.groupBy("conv_id").agg(F.array_join(F.transform(in_order, lambda p: p["letters"]), "").alias("letters"), *sums, F.min("low").alias("low"), F.max("high").alias("high"))
    roles = F.translate(F.col("letters"), TRUNCATED + GONE, PLAIN + PLAIN)
    legal = sum((F.length(roles) - F.length(F.replace(roles, F.lit(p), F.lit("")))) / 2 for p in ("su", "ua", "au"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return whole.select("conv_id", F.translate("letters", GONE, "dddd").alias("letters"), gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.length(roles) - 1 - legal).cast("long").alias("illegal"))


def _settled(own: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """(cost, edit, next state) of a node's states, with insertions before it."""
    cost = [c for c, _, _ in own]
    for _ in range(3):
        cost = [min(c, INSERT + cost[NEXT[s][1]]) for s, c in enumerate(cost)]
    out = []
    for s, (c, edit, to) in enumerate(own):
        made = (cost[s], "I", NEXT[s][1]) if INSERT + cost[NEXT[s][1]] == cost[s] else None
        kept = (c, edit, to) if c == cost[s] else None
        out.append(min((x for x in (made, kept) if x), key=lambda x: x[1]) if cost[s] < NEVER else (NEVER, "", s))
    return out


END = _settled([(0, "", NOTHING), (NEVER, "", SYSTEM), (NEVER, "", USER), (0, "", ASSISTANT)])


def node(letter: str, after: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The node that reads ``letter`` and goes on to ``after``."""
    own = []
    for s in range(4):
        ways = [(DELETE + after[s][0], "D", s)]
        if letter != "d":
            extra = CUT if letter in TRUNCATED else 0
            role, (expected, to) = letter.lower(), NEXT[s]
            if role == expected:
                ways.append((extra + after[to][0], "K", to))
            elif role == "s" and s == NOTHING:
                ways.append((extra + after[SYSTEM][0], "K", SYSTEM))
            ways.append((RETURN + extra + after[to][0], "R", to))
        own.append(min(ways, key=lambda w: (w[0], w[1])))
    return _settled(own)


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures in order of their reverse -> (letters, cost, audit)."""
    path, nodes = "", [END]
    for batch in batches:
        out = []
        for back in batch.column(0).to_pylist():
            low, high = 0, min(len(path), len(back))
            while low < high:  # the shared ending, by halving
                mid = (low + high + 1) // 2
                low, high = (mid, high) if path[:mid] == back[:mid] else (low, mid - 1)
            del nodes[low + 1 :]
            for letter in back[low:]:
                nodes.append(node(letter, nodes[-1]))
            path = back
            depth, state, edits = len(back), NOTHING, []
            while True:
                _, edit, to = nodes[depth][state]
                if not edit:
                    break
                edits.append(edit)
                depth, state = depth - (edit != "I"), to
            out.append((back[::-1], nodes[-1][NOTHING][0], "".join(edits)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["letters", "cost", "audit"])


def cheapest_edits(letters: DataFrame) -> DataFrame:
    """(letters, cost, audit) for each different signature."""
    back = letters.select(F.reverse("letters").alias("back")).distinct()
    parted = back.repartitionByRange(partitions(back.sparkSession), "back").sortWithinPartitions("back")
    return parted.mapInArrow(solved, "letters string, cost long, audit string")


_FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = f"conv_id long, {', '.join(c + ' long' for c in _FACTS)}, audit string, repaired_sha256 string"


def repaired(edits: Iterator[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The (role, text) that edits make of rows."""
    state = NOTHING
    for edit in edits:
        expected, to = NEXT[state]
        if edit == "I":
            yield ROLE[expected], ""
            state = to
            continue
        role, text = next(rows)
        if edit == "R":
            role = ROLE[expected]
        if edit != "D":
            yield role, text
            state = SYSTEM if state == NOTHING and role[:1] == "s" else to


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's head (facts and edits), then its rows in order."""
    names = [x.split()[0] for x in _RESULT.split(", ")]
    types = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]

    def incoming() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    stream = incoming()
    ahead = next(stream, None)

    def own_rows() -> Iterator[tuple[str, str]]:
        nonlocal ahead
        while ahead is not None and not ahead[0]:
            row, ahead = ahead, next(stream, None)
            yield row[1:3]

    out: list[tuple] = []
    while ahead is not None:
        head, ahead = ahead, next(stream, None)
        rows, digest, between = own_rows(), hashlib.sha256(), ""
        for role, text in repaired(iter(head[-1]), rows):
            digest.update(f"{between}{role}:{text}".encode())
            between = "\n"
        for _ in rows:  # none is left, unless the head has no edits
            pass
        out.append((*head[3:], digest.hexdigest()))
        if len(out) == 1000 or ahead is None:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()


def repair(conversations: DataFrame, label: str = "conversations") -> DataFrame:
    """The facts, edits and hash of the repaired rows of every conversation."""
    bounded_batches(conversations.sparkSession)
    ws = Workspace(conversations.sparkSession, label)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    left = damaged(rows)
    signed = ws.keep(signatures(left, ws), "signatures")
    edits = ws.keep(cheapest_edits(signed), "edits")
    ws.drop("flags")
    told = signed.join(edits, "letters").select(F.col("conv_id").alias("c"), *_FACTS, "audit")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _FACTS]
    every = rows.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    heads = every.select(F.lit(True).alias("head"), F.lit("").alias("role"), F.lit("").alias("text"), "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.lit(None).cast("long").alias("turn"))
    nothing = [F.lit(None).cast("long").alias(c) for c in _FACTS]
    body = left.select(F.lit(False).alias("head"), "role", "text", "conv_id", *nothing, F.lit(None).cast("string").alias("audit"), "turn")
    both = heads.unionByName(body).withColumn("digest", F.when(~F.col("head"), F.unhex(F.md5(F.col("text").cast("binary")))))
    placed = both.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.desc("head"), *_order()[1:])
    return placed.select("head", "role", "text", "conv_id", *_FACTS, "audit").mapInArrow(_follow, _RESULT)


def op12(conversations: DataFrame) -> DataFrame:
    return repair(conversations)
