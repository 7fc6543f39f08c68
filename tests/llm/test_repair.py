"""Conversation repair against plain programmes."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from conftest import SF_SMALL
from textlab.llm import repair as R
from textlab.llm.queries import QUERIES

SOLID = re.compile(r"[^\x20\x09-\x0D]")
ROLES = {"u": "user", "a": "assistant"}


def damage(rows):
    """Contract damage of (conv, turn, role, text) rows -> conv -> sorted rows."""
    out = {}
    show = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = show(role), show(text)
        code = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if code == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else
                   "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, most_inserts=None):
    """(cost, audit) over whole strings: every state keeps all its cheapest audits' least, by comparing full strings."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserts(best):
        for _ in range(4):
            for s, (c, a) in list(best.items()):
                t, new = after[s], (c + 5, a + "I")
                if t not in best or new < best[t]:
                    best[t] = new
        return best
    best = {"": (0, "")}
    for initial, gone, cut in turns:
        now = {}

        def put(s, v):
            if s not in now or v < now[s]:
                now[s] = v
        for s, (c, a) in inserts(best).items():
            put(s, (c + 2, a + "D"))
            if not gone:
                if initial and s + initial in ("s", "u", "su", "ua", "au"):
                    put(initial, (c + 5 * cut, a + "K"))
                put(after[s], (c + 1 + 5 * cut, a + "R"))
        best = now
    return min(v for s, v in inserts(best).items() if s in ("", "a"))


def exhaustive(turns, inserts=2):
    """All edit sequences with at most so many inserts before each turn and at the end."""
    found = []
    gaps = len(turns) + 1
    for edits in itertools.product("KRD", repeat=len(turns)):
        for more in itertools.product(range(inserts + 1), repeat=gaps):
            state, cost, audit, ok = "", 0, "", True
            for k in range(gaps):
                for _ in range(more[k]):
                    state, cost, audit = {"u": "a"}.get(state, "u"), cost + 5, audit + "I"
                if k == len(turns):
                    break
                initial, gone, cut = turns[k]
                e = edits[k]
                audit += e
                if e == "D":
                    cost += 2
                    continue
                if gone or e == "K" and (initial and state + initial) not in ("s", "u", "su", "ua", "au"):
                    ok = False
                    break
                state = initial if e == "K" else {"u": "a"}.get(state, "u")
                cost += 5 * cut + (e == "R")
            if ok and state in ("", "a"):
                found.append((cost, audit))
    return min(found)


def answer(rows):
    """The contract's row of one conversation."""
    f = faults(rows)
    count = collections.Counter(f)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = cheapest([(r[:1], x in ("blank", "duplicate"), x == "truncated") for (_, r, _), x in zip(rows, f)])
    lines, state, it = [], "", iter(rows)
    for e in audit:
        _, role, text = next(it) if e != "I" else (None, None, "")
        if e == "D":
            continue
        state = role[:1] if e == "K" else {"u": "a"}.get(state, "u")
        lines.append(f"{role if e == 'K' else ROLES[state]}:{text}")
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in R.repair_conversations(df, **options).collect()}
    want = {c: answer(v) for c, v in damage(rows).items()}
    assert got == want
    return got


@pytest.mark.parametrize("inserts", [2])
def test_programme_is_cheapest_of_all(inserts):
    rng = random.Random(5)
    for _ in range(60):
        turns = [(rng.choice("suuaaax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 4))]
        assert cheapest(turns) == exhaustive(turns, inserts)


@pytest.mark.parametrize("modulus", [R.MODULUS, 3])
def test_audits_equal_plain_strings(modulus):
    """Also where the hash collides all the time: the walk back finds the first difference."""
    rng = random.Random(7)
    for _ in range(200):
        turns = [(rng.choice("suuaaax"), rng.random() < 0.1, rng.random() < 0.1) for _ in range(rng.randint(0, 40))]
        best, audits = R.best_audits(turns, audits=R.Audits(modulus=modulus))
        cost, state, more = R._ended({s: c for s, (c, _) in best.items()}, R._ranks(audits, best))
        assert (cost, audits.text(best[state][1]) + more) == cheapest(turns)


def test_ancestors():
    audits, node, nodes = R.Audits(), 0, [0]
    for k in range(300):
        node = audits.add(node, "DIKR"[k % 4])
        nodes.append(node)
    assert all(audits.ancestor(node, d) == nodes[d] for d in range(301))


def test_op11_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
           for r in QUERIES["op11_audit_repair"][0](spark, SF_SMALL).collect()}
    assert got == {c: answer(v) for c, v in damage(rows).items()}


def test_many_short_and_one_long_conversation(spark):
    """A conversation with half of all turns lies in several partitions and blocks."""
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "cut off", " \t", "", "Σ é.", "x" * 4000 + ".", None]
    rows = [(rng.randint(0, 30), rng.randint(0, 9), rng.choice(["user", "assistant", "system", "tool", "", None]),
             rng.choice(texts)) for _ in range(300)]
    rows += [(99, k, ["user", "assistant", "user", "system"][rng.randint(0, 3)], f"{rng.choice(texts)} {k}{rng.choice('.!x')}")
             for k in range(300)]
    first = check(spark, rows, block_turns=7)
    assert check(spark, rows[::-1]) == first


def test_edges(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    null = next(k for k in range(1000) if zlib.crc32(f" :{k}".encode()) % 20 > 4)
    got = check(spark, [(dropped, 0, "user", "all of it goes."), (None, null, "user", "a."), (None, null + 20, None, None),
                        (5, None, "user", "one."), (5, None, "user", "one."), (5, None, "assistant", "two."), (5, None, "tool", "x."),
                        (6, 3, "user", "same."), (6, 3, "user", "same."), (6, 7, "user", "same."), (7, 2 ** 62, "user", "far.")])
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_equal_turns_in_one_conversation(spark):
    """Very many copies of one turn are one row until they reach the audit."""
    check(spark, [(1, 1, "user", "again and again.")] * 5000 + [(1, 2, "assistant", "yes.")] * 3, block_turns=64)


def test_empty_and_clashing(spark):
    schema = "conv_id int, turn int, role string, text string, code string, copies string, digest int, first string"
    assert R.repair_conversations(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, 0, "user", "hello.", "x", "y", 1, "z"), (1, 1, "assistant", "yes.", "x", "y", 1, "z")]
    got = R.repair_conversations(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 1 and got[0]["conv_id"] == 1
