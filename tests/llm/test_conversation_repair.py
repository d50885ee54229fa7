"""Conversation repair against a search over all edit sequences that keeps the cheapest, least one per state."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from auctionstream.llm import conversation_repair as cr, queries

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def brute(codes):
    """(cost, letters) of the best edits, found backwards over (row, last role)."""
    best = {q: (0, "") if q in ("", "a") else (10**6, "~") for q in NEXT}
    for i in range(len(codes), -1, -1):
        if i < len(codes):
            initial, must_go, cut = codes[i]
            ways = {q: [(best[q][0] + 3, "D" + best[q][1])] for q in NEXT}
            for q in NEXT:
                for role in NEXT[q] if not must_go else "":
                    cost, rest = best[role]
                    if role == initial:
                        ways[q].append((cost + cut, "K" + rest))
                    if role in "ua":
                        ways[q].append((cost + cut + 2, "R" + rest))
            best = {q: min(w) for q, w in ways.items()}
        for _ in range(4):  # empty rows before this one
            best = {q: min([best[q], *[(best[r][0] + 2, "I" + best[r][1]) for r in NEXT[q] if r != "s"]]) for q in NEXT}
    return best[""]


CODE = st.tuples(st.sampled_from("suuaaaux"), st.sampled_from([False] * 3 + [True]), st.booleans())


@settings(max_examples=400, deadline=None)
@given(st.lists(CODE, max_size=14))
def test_search_finds_the_cheapest_and_least_edits(codes):
    codes = [(i, m, c and not m) for i, m, c in codes]
    cost, letters = brute(codes)
    assert cr.search(codes) == letters and cr.cost_of(letters, codes) == cost


@settings(max_examples=40, deadline=None)
@given(st.lists(CODE, min_size=20, max_size=60), st.integers(1, 40))
def test_cuts_change_nothing(codes, cut):
    codes = [(i, m, c and not m) for i, m, c in codes]
    cost, letters = brute(codes)
    head, tail = codes[:cut], codes[cut:]
    after = cr.applied(cr.table(tail), cr.AT_END)
    first = cr.search(head, cr.START, after)
    state = cr.follow(first, head)
    assert first + cr.search(tail, state) == letters
    assert cr.applied(cr.table(head), after)[cr.START] == cost


def test_blocks_of_a_long_conversation():
    rng = random.Random(3)
    codes = [(rng.choice("suuaax"), rng.random() < 0.1, rng.random() < 0.3) for _ in range(700)]
    codes = [(i, m, c and not m) for i, m, c in codes]
    assert cr.blockwise(codes) == brute(codes)[1]
    assert cr.blockwise([("u", False, False)] * 300) == brute([("u", False, False)] * 300)[1]


def plain(rows):
    """The whole query in plain Python; rows are (conv_id, turn, role, text)."""
    conversations = {}
    for conv, turn, role, text in rows:
        mine = conversations.setdefault(conv, [])
        shown = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(shown.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, mine in conversations.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in mine:
            last = text.rstrip(SPACE)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
            seen.add((role, text))
        codes = [(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(mine, faults)]
        cost, letters = brute(codes)
        lines, at, role = [], 0, ""
        for letter in letters:
            if letter == "D":
                at += 1
                continue
            role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[role[:1]] if letter in "IR" else mine[at][1]
            lines.append(f"{role}:{'' if letter == 'I' else mine[at][2]}")
            at += letter != "I"
        turns = [r[0] for r in mine if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, letters, sha)
    return out


def as_dict(df):
    rows = df.collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


SCHEMA = "conv_id long, turn long, role string, text string, kind string, steps int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def made(seed, conv, n):
    rng = random.Random(seed)
    words = ["Yes.", "No", "Why? ", "Ok!", "", " \t", "Long ago\n", "See: 3.5.", "é☃."]
    return [(conv, rng.choice([t, t, t, t + 5]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), f"{rng.choice(words)}") for t in range(n)]


def test_query_on_the_whole_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert as_dict(queries.op12_conversation_repair(spark, folder)) == plain([tuple(r) for r in rows])


@pytest.mark.parametrize("partitions", [1, 7])
def test_odd_and_long_conversations(spark, partitions):
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (2, 0, "user", ""), (None, 3, "user", "No id."), (None, None, None, "x"), (3, 0, "", "Empty role.")]
    rows += [(4, 1, "user", "Same."), (4, 1, "user", "Same."), (4, 2, "user", "Same."), (5, 9, "assistant", "w " * 20_000)]
    rows += [r for c in range(10, 60) for r in made(c, c, c % 9)]
    rows += made(1, 7, 2_500)  # of which every partition gets a piece
    rows += [(8, t, "user", "again.") for t in range(300)]
    rows += [(100 + i, t, "user", "dropped?") for i in range(60) for t in [i]]
    damaged = cr.damaged(table(spark, rows))
    result = cr.repair(damaged, partitions)
    expected = plain(rows)
    assert as_dict(cr.digest(result)) == expected
    lines = {}
    for r in cr.repaired_rows(result).orderBy("conv_id", "part", "nr", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    hashes = {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in expected}
    assert hashes == {c: v[-1] for c, v in expected.items()}


def test_empty_table(spark):
    none = cr.repair(cr.damaged(table(spark, [(1, 1, "user", "x")]).limit(0)))
    assert cr.digest(none).collect() == [] and cr.repaired_rows(none).collect() == []
