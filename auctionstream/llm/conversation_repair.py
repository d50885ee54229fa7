"""Repair of conversation structure by iterative-deepening A* over edit sequences.

A conversation is legal if its roles are an optional system row and then user and assistant in turns. Rows are kept,
given another role, deleted, and empty rows inserted, at a cost each. The cheapest edits are sought depth first, in
ASCII order of their letters, under a growing bound; a table of failed states cuts what was tried in vain. The first
sequence that a bound lets through is the answer: the cheapest, and of those the least.

Conversations are cut by range of (conversation, order), so one of any length is spread over tasks. Pieces of a
conversation that crosses tasks, and blocks of BLOCK rows in a long one, are tied together by the least cost of what
follows, per state at the cut: a product of 4 x 4 tables.
"""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from auctionstream.plans.ranges import PART, Groups, in_ranges
from auctionstream.session import stage

#: Rows that one search runs over.
BLOCK = 64
#: A conversation of more rows is handed on in pieces, as one that crosses tasks is.
MOST_ROWS = 1_024
STEPS_AT_ONCE = 1_024
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 3, 2, 2, 1

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
#: What the rows so far end in: nothing, the system row, a user's row, an assistant's row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, NEVER = 4, 1 << 40
_TO = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_MADE = (USER, USER, ASSISTANT, USER)  # where a row of a chosen role leads
_LEGAL = ("su", "ua", "au")
#: The least cost of ending a conversation in a state, by inserting rows.
AT_END = (0, 2 * INSERT_COST, INSERT_COST, 0)
Code = tuple[str, bool, bool]  # initial of the role, must go, truncated


# ---- the search ---------------------------------------------------------------------------------


def _steps_of(code: Code, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, next state and cost of the edits that use up a row, in order of their letters."""
    initial, must_go, cut = code
    yield "D", state, DELETE_COST
    if not must_go:
        if (to := _TO.get((initial, state))) is not None:
            yield "K", to, TRUNCATED_COST * cut
        yield "R", _MADE[state], REROLE_COST + TRUNCATED_COST * cut


def _least(code: Code) -> int:
    initial, must_go, cut = code
    return DELETE_COST if must_go else min(DELETE_COST, TRUNCATED_COST * cut + REROLE_COST * (initial not in ("s", "u", "a")))


def search(codes: list[Code], state: int = START, after: tuple[int, ...] | None = None) -> str:
    """The letters of the cheapest edits of these rows, of equal ones the least.

    ``after``: the least cost of what follows the last row, per state there; insertions behind it are then not these
    rows' matter. None at the end of a conversation.
    """
    n = len(codes)
    at_least = [0 if after is None else min(after)] * (n + 1)
    for i in range(n - 1, -1, -1):
        at_least[i] = at_least[i + 1] + _least(codes[i])
    failed: dict[tuple[int, int], int] = {}  # the largest rest of a bound with which a state failed

    def edits(i: int, q: int) -> list[tuple[str, int, int, int]]:
        consuming = [(c, i + 1, to, cost) for c, to, cost in _steps_of(codes[i], q)] if i < n else []
        inserted = [("I", i, _MADE[q], INSERT_COST)] if i < n or after is None else []
        return sorted(consuming + inserted)

    def accepts(i: int, q: int, rest: int) -> bool:
        ends = (0 if q in (START, ASSISTANT) else NEVER) if after is None else after[q]
        return i == n and ends <= rest

    bound = at_least[0]
    while True:
        # Depth first without recursion: a frame is a state, its rest, its edits, and the one that is being tried.
        path: list[list] = []
        i, q, rest = 0, state, bound
        while True:
            if accepts(i, q, rest):
                return "".join(frame[3][frame[4]][0] for frame in path)
            if rest >= at_least[i] and failed.get((i, q), -1) < rest:
                path.append([i, q, rest, edits(i, q), -1])
            while path:
                frame = path[-1]
                frame[4] += 1
                if frame[4] < len(frame[3]):
                    break
                failed[frame[0], frame[1]] = frame[2]
                path.pop()
            if not path:
                break
            _, i, q, cost = frame[3][frame[4]]
            rest = frame[2] - cost
        bound += 1


def follow(audit: str, codes: list[Code], state: int = START) -> int:
    """The state in which these edits leave the conversation."""
    i = 0
    for letter in audit:
        if letter in "KR":
            state = _TO[codes[i][0], state] if letter == "K" else _MADE[state]
        elif letter == "I":
            state = _MADE[state]
        i += letter != "I"
    return state


def cost_of(audit: str, codes: list[Code]) -> int:
    total, i = 0, 0
    for letter in audit:
        if letter == "I":
            total += INSERT_COST
            continue
        cut = TRUNCATED_COST * codes[i][2]
        total += {"D": DELETE_COST, "K": cut, "R": REROLE_COST + cut}[letter]
        i += 1
    return total


def _before(code: Code, after: tuple[int, ...]) -> tuple[int, ...]:
    """The least cost per state before a row, inserted rows in front of it included."""
    cost = [min(c + after[to] for _, to, c in _steps_of(code, q)) for q in range(STATES)]
    # One or two insertions reach every state that insertions reach.
    once = [min(cost[q], INSERT_COST + cost[_MADE[q]]) for q in range(STATES)]
    return tuple(min(cost[q], INSERT_COST + once[_MADE[q]]) for q in range(STATES))


def costs_to_go(codes: list[Code], after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The least cost per state at the cuts between blocks, from the first cut to the end."""
    cuts, now = [after], after
    for i in range(len(codes) - 1, 0, -1):
        now = _before(codes[i], now)
        if i % BLOCK == 0:
            cuts.append(now)
    return cuts[::-1]


def table(codes: list[Code]) -> list[int]:
    """The least cost from every state before these rows to every state behind their last one, row by row."""
    columns = []
    for to in range(STATES):
        now = tuple(0 if q == to else NEVER for q in range(STATES))
        for code in reversed(codes):
            now = _before(code, now)
        columns.append(now)
    return [min(NEVER, columns[to][q]) for q in range(STATES) for to in range(STATES)]


def applied(costs: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(costs[q * STATES + to] + after[to] for to in range(STATES)) for q in range(STATES))


def blockwise(codes: list[Code], state: int = START, after: tuple[int, ...] | None = None) -> str:
    """``search`` in blocks of BLOCK rows, each knowing what the rest costs from its end."""
    if len(codes) <= BLOCK:
        return search(codes, state, after)
    found, cuts = [], costs_to_go(codes, AT_END if after is None else after)
    for k, begin in enumerate(range(0, len(codes), BLOCK)):
        part = codes[begin : begin + BLOCK]
        last = begin + BLOCK >= len(codes)
        found.append(search(part, state, after if last else cuts[k]))
        state = follow(found[-1], part, state)
    return "".join(found)


def steps_of(audit: str, rows: list[tuple[str, str]], state: int = START) -> list[tuple[str, str, str]]:
    """Letter, role and text of every edit; rows are (role, text)."""
    out, i = [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[i]
        if letter in "IR":
            state = _MADE[state]
            role = "user" if state == USER else "assistant"
        elif letter == "K":
            state = _TO[role[:1], state]
        out.append((letter, role, text))
        i += letter != "I"
    return out


# ---- rows and their faults ----------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone``, after damage by crc32 of ``conv_id:turn`` modulo 20: 0 marks a row gone,
    1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats the row, 4 makes its role user. Null roles, texts and parts
    of the hashed text are one space; a null conv_id or turn stays null."""
    blank = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(F.encode(name, "UTF-8")) % 20
    text = F.coalesce("text", blank)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", blank))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies).drop("copy")


def _turn_order() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``digest`` of the text and the first fault that holds: blank, duplicate (but of a row of the same turn), truncated.

    The least turn of equal rows is found by an aggregate with map-side minima, so equal rows needn't meet in a task.
    """
    space = r"[\x20\x09-\x0D]"
    named = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    repeated = (
        named.where("NOT gone").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
        .agg(F.min(_turn_order()).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.col("least").isNotNull() & (F.col("least") < _turn_order()), DUPLICATE)
        .when(~F.col("text").rlike(rf"[.!?]{space}*\z"), TRUNCATED)
    )
    return named.join(repeated, same, "left").withColumn("fault", fault).drop("c", "r", "d", "least")


# ---- pieces of conversations --------------------------------------------------------------------

COUNTS = ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")
_STEPS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_STEPS_TYPE = "array<struct<edit: string, role: string, text: string>>"


def _fields(turn: str) -> dict[str, str]:
    """What ``_in_partition`` returns beside conv_id, in order."""
    longs = dict.fromkeys(COUNTS, "long")
    ends = {"first_turn": turn, "last_turn": turn, "turns": "long", "first_role": "string", "last_role": "string"}
    return {
        "kind": "string", **longs, **ends, "costs": "array<long>", "steps": _STEPS_TYPE,
        "place": "long", "role": "string", "text": "string", "fault": "string",
    }


def _counts(turns: list, roles: list[str], faults: list) -> dict:
    known = [t for t in turns if t is not None]
    distinct = sum(a != b for a, b in zip(known, [None, *known]))
    initials = [r[:1] for r in roles]
    return {
        "gaps": known[-1] - known[0] + 1 - distinct if known else 0, "first_turn": known[0] if known else None,
        "last_turn": known[-1] if known else None, "turns": distinct, "first_role": initials[0] if roles else None,
        "last_role": initials[-1] if roles else None, "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
        **{f: sum(x == f for x in faults) for f in (BLANK, DUPLICATE, TRUNCATED)},
    }


def _codes(roles: list[str], faults: list) -> list[Code]:
    return [(r[:1], f in (BLANK, DUPLICATE), f == TRUNCATED) for r, f in zip(roles, faults)]


def _in_partition(rows: pa.Table, groups: Groups) -> dict:
    """Of every conversation that surely lies within the partition its counts and steps; of others, and of long ones, the
    counts and the table of costs of the piece, and its rows."""
    columns = {c: rows[c].to_pylist() for c in ("turn", "role", "text", "fault", "digest", "gone")}
    out: dict[str, list] = {c: [] for c in ("source", *_fields(""))}

    def emit(source: int, kind: str, **values) -> None:
        for c in out:
            out[c].append(source if c == "source" else kind if c == "kind" else values.get(c))

    cuts = [*np.flatnonzero(groups.place == 0).tolist(), rows.num_rows]
    for begin, end in zip(cuts, cuts[1:]):
        live = [i for i in range(begin, end) if not columns["gone"][i]]
        turns, roles, texts, faults, digests = ([columns[c][i] for i in live] for c in ("turn", "role", "text", "fault", "digest"))
        for k in range(1, len(live)):  # equal rows of one turn stand side by side
            if faults[k] != BLANK and (turns[k], roles[k], digests[k]) == (turns[k - 1], roles[k - 1], digests[k - 1]):
                faults[k] = DUPLICATE
        counts, codes = _counts(turns, roles, faults), _codes(roles, faults)
        if groups.begins_before[begin] or groups.goes_on[begin] or len(live) > MOST_ROWS:
            emit(begin, "piece", **counts, costs=table(codes))
            for k in range(len(live)):
                emit(begin, "row", place=k, role=roles[k], text=texts[k], fault=faults[k])
        else:
            audit = blockwise(codes)
            emit(begin, "whole", **counts, cost=cost_of(audit, codes), steps=steps_of(audit, list(zip(roles, texts))))
    take = pa.array(out.pop("source"), pa.int64())
    turn = rows["turn"].type
    kinds = {"kind": pa.string(), "first_turn": turn, "last_turn": turn, "first_role": pa.string(), "last_role": pa.string(),
             "costs": pa.list_(pa.int64()), "steps": _STEPS, "role": pa.string(), "text": pa.string(), "fault": pa.string()}
    arrays = {}
    for c, values in out.items():
        if c == "steps":
            values = [None if v is None else [dict(zip(("edit", "role", "text"), s)) for s in v] for v in values]
        arrays[c] = pa.array(values, kinds.get(c, pa.int64()))
    return {"conv_id": rows["conv_id"].take(take), **arrays}


class Repaired(NamedTuple):
    """``whole``: a row per conversation with its counts and ``steps``. ``long``: a row per other conversation with its
    counts. ``long_steps``: conv_id, part, nr and ``steps`` of those, in portions that follow each other."""

    whole: DataFrame
    long: DataFrame
    long_steps: DataFrame


def _same_piece(left: DataFrame, right: DataFrame) -> DataFrame:
    named = right.withColumnsRenamed({"conv_id": "__c", PART: "__p"})
    return left.join(named, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col(PART) == F.col("__p"))).drop("__c", "__p")


def repair(rows: DataFrame, partitions: int | None = None) -> Repaired:
    """The cheapest edits of every conversation. Columns read: conv_id, turn (whole number), role, text, gone; rows marked gone only
    say that their conversation exists.

    Rows are ordered by turn, nulls first, then role, then the digest of the text. A null conv_id is a conversation, an
    empty role has no legal initial. Equal rows of a turn are copies of each other. A conversation without rows has no
    steps and counts of 0; an empty table gives no row. Runs jobs when called and writes below the shared folder.
    """
    faulty = with_faults(rows).select("conv_id", "turn", "role", "digest", "text", "gone", "fault")
    types = dict(faulty.dtypes)
    fields = ", ".join(f"{c} {kind}" for c, kind in {"conv_id": types["conv_id"], **_fields(types["turn"])}.items())
    found = in_ranges(faulty, ["conv_id"], ["turn", "role", "digest"], _in_partition, fields, "repaired", partitions)
    key = f"conv_id {types['conv_id']}"
    counts = list(COUNTS)
    pieces = found.where("kind = 'piece'").drop("kind", "steps", "place", "role", "text", "fault", "cost")

    def ahead(part: pd.DataFrame) -> pd.DataFrame:
        """What follows each piece costs, per state. A conversation has a row per range partition at most."""
        part, now, out = part.sort_values(PART), AT_END, []
        for k, row in enumerate(reversed(list(part.itertuples(index=False)))):
            out.append((row.conv_id, row.part, k == 0, list(now)))
            now = applied(list(row.costs), now)
        return pd.DataFrame(out, columns=["conv_id", PART, "last", "after"])

    def totals(part: pd.DataFrame) -> pd.DataFrame:
        rows, now = list(part.sort_values(PART).itertuples(index=False)), AT_END
        for row in reversed(rows):
            now = applied(list(row.costs), now)
        known = [r for r in rows if r.turns]
        distinct = sum(r.turns for r in known) - sum(a.last_turn == b.first_turn for a, b in zip(known, known[1:]))
        roles = [r for r in rows if r.first_role is not None]
        illegal = sum(r.illegal for r in rows) + sum(a.last_role + b.first_role not in _LEGAL for a, b in zip(roles, roles[1:]))
        gaps = int(known[-1].last_turn) - int(known[0].first_turn) + 1 - distinct if known else 0
        total = [gaps, *(sum(getattr(r, c) for r in rows) for c in (BLANK, DUPLICATE, TRUNCATED)), illegal, now[START]]
        return pd.DataFrame([(rows[0].conv_id, *map(int, total))], columns=["conv_id", *counts])

    # pandas has no names that begin with underscores in its tuples, and no integers with nulls.
    plain = pieces.select(
        "conv_id", PART, F.col(PART).alias("part"), BLANK, DUPLICATE, TRUNCATED, "illegal", "turns", "first_role", "last_role", "costs",
        F.coalesce(F.col("first_turn"), F.lit(0)).alias("first_turn"), F.coalesce(F.col("last_turn"), F.lit(0)).alias("last_turn"),
    )
    long = plain.groupBy("conv_id").applyInPandas(totals, f"{key}, " + ", ".join(f"{c} long" for c in counts))
    following = stage(plain.groupBy("conv_id").applyInPandas(ahead, f"{key}, {PART} int, last boolean, after array<long>"), "following")

    def audits(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        codes, first = _codes(part["role"].tolist(), part["fault"].tolist()), part.iloc[0]
        out = []
        for state in range(STATES):
            audit = blockwise(codes, state, None if first["last"] else tuple(int(x) for x in first["after"]))
            out.append((first["conv_id"], first[PART], state, follow(audit, codes, state), audit))
        return pd.DataFrame(out, columns=["conv_id", PART, "state", "to", "audit"])

    def entered(part: pd.DataFrame) -> pd.DataFrame:
        state, out = START, []
        for number, piece in part.sort_values(PART).groupby(PART, sort=True):
            out.append((piece["conv_id"].iloc[0], number, state))
            state = int(piece.set_index("state")["to"].loc[state])
        return pd.DataFrame(out, columns=["conv_id", PART, "entry"])

    piece_rows = found.where("kind = 'row'").select("conv_id", PART, "place", "role", "text", "fault")
    codes = _same_piece(piece_rows.drop("text"), following)
    tried = stage(codes.groupBy("conv_id", PART).applyInPandas(audits, f"{key}, {PART} int, state int, to int, audit string"), "audits")
    entries = tried.select("conv_id", PART, "state", "to").groupBy("conv_id").applyInPandas(entered, f"{key}, {PART} int, entry int")
    chosen = _same_piece(tried, entries).where("state = entry").select(
        F.col("conv_id").alias("c"), F.col(PART).alias("p"), F.col("state").alias("entry"), "audit"
    )

    def edited(rows: pd.DataFrame, audit: pd.DataFrame) -> pd.DataFrame:
        rows, one = rows.sort_values("place"), audit.iloc[0]
        steps = steps_of(one["audit"], list(zip(rows["role"], rows["text"])), int(one["entry"]))
        named = [dict(zip(("edit", "role", "text"), s)) for s in steps]
        return pd.DataFrame([
            (one["c"], one["p"], at // STEPS_AT_ONCE, named[at : at + STEPS_AT_ONCE]) for at in range(0, len(named), STEPS_AT_ONCE)
        ], columns=["conv_id", PART, "nr", "steps"])

    long_steps = piece_rows.drop("fault").groupBy("conv_id", PART).cogroup(chosen.groupBy("c", "p")).applyInPandas(
        edited, f"{key}, {PART} int, nr int, steps {_STEPS_TYPE}"
    )
    return Repaired(found.where("kind = 'whole'").select("conv_id", *counts, "steps"), long, long_steps)


def _lines(steps: Column) -> Column:
    left = F.filter(steps, lambda s: s["edit"] != "D")
    return F.array_join(F.transform(left, lambda s: F.concat(s["role"], F.lit(":"), s["text"])), "\n")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation, portion by portion; rows come in order, conversations one after the other."""
    now, sha, letters, begun = None, hashlib.sha256(), [], False

    def row(kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now], kind), pa.array(["".join(letters)]), pa.array([sha.hexdigest()])], ["conv_id", "audit", "repaired_sha256"]
        )

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for conv, audit, lines, empty in zip(*[c.to_pylist() for c in batch.columns]):
            if begun and conv != now:
                yield row(kind)
                sha, letters = hashlib.sha256(), []
            if not begun or conv != now:
                now, begun, any_line = conv, True, False
            letters.append(audit)
            if not empty:
                sha.update(("\n" if any_line else "").encode() + lines.encode())
                any_line = True
    if begun:
        yield row(kind)


def digest(repaired: Repaired) -> DataFrame:
    """conv_id, the counts, cost, audit and repaired_sha256 per conversation.

    A hash over all lines can only be taken in their order: of a long conversation one task reads the portions, one at a time.
    """
    edits = lambda steps: F.array_join(F.transform(steps, lambda s: s["edit"]), "")
    whole = repaired.whole.select(
        "conv_id", *COUNTS, edits(F.col("steps")).alias("audit"), F.sha2(_lines(F.col("steps")), 256).alias("repaired_sha256")
    )
    empty = ~F.exists("steps", lambda s: s["edit"] != "D")
    portions = repaired.long_steps.select(
        "conv_id", edits(F.col("steps")).alias("audit"), _lines(F.col("steps")).alias("lines"), empty.alias("empty"), PART, "nr"
    )
    key = dict(repaired.long.dtypes)["conv_id"]
    in_order = portions.repartition("conv_id").sortWithinPartitions("conv_id", PART, "nr").drop(PART, "nr")
    streamed = in_order.mapInArrow(_streamed, f"conv_id {key}, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "__c")
    long = repaired.long.join(streamed, F.col("conv_id").eqNullSafe(F.col("__c")), "left")
    return whole.union(long.select(
        "conv_id", *COUNTS, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    ))


def repaired_rows(repaired: Repaired) -> DataFrame:
    """The repaired conversations: conv_id, part and nr (order of portions), place in the portion, edit, role, text."""
    whole = repaired.whole.select("conv_id", F.lit(0).alias(PART), F.lit(0).alias("nr"), "steps")
    rows = whole.unionByName(repaired.long_steps).select("conv_id", F.col(PART).alias("part"), "nr", F.posexplode("steps").alias("place", "step"))
    return rows.where("step.edit <> 'D'").select("conv_id", "part", "nr", "place", "step.*")
