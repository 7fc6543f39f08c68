"""Conversation structure repair by a dynamic programme over audits.

A conversation is repaired to the role initials ``(s?(ua)+)?`` by the cheapest
edits: keep (K, 0), re-role to user or assistant (R, 1), delete (D, 2; a must
for blank and repeated turns), insert an empty turn (I, 5); a turn that stays
though cut off adds 5. Of the cheapest, the audit (the initials of its edits in
order) that is least in ASCII is taken.

The programme goes through the turns with one best audit per state: nothing
yet, after ``s``, ``u`` or ``a``. Audits are persistent: an edit is a node
that points to the audit before it, with binary-lifting ancestors and a rolling
hash, so all share their prefixes. Of two audits that cost the same, the longest
common prefix is found by descending the ancestors while hashes differ; equal
hashes are verified by walking back until both audits are one node. An audit
says which turns it consumed and hence its state, so two audits for the same turns
never are prefixes of one another unless one goes on with inserts alone, and the
smaller one stays the smaller whatever follows.

Spark sorts all turns by conversation and turn (a range exchange, so a
conversation with a third of all turns lies in many partitions). A task repairs
the conversations that lie within it and have at most ``BLOCK`` turns. The
others, and those at the ends of a partition, are cut into blocks; a block
gives, for each state it may start in, the cost, audit and rank of the best
audit to each end state. A conversation's few block tables are put together,
then its audit and the turns are joined as a sorted stream that writes the
SHA-256 (sequential by its nature, in constant memory).

Nulls in role and text are one space, in the damage key too; null turns come
first. Turns with equal numbers are in the order of role and text. Equal turns
(also those equal after damage) are counted before the sort, so many copies are
one row. A role other than s..., u..., a... can only be re-roled or deleted. Texts of any
length are taken whole. Conversations all of whose turns are dropped get zeros,
an empty audit and the hash of the empty string. A null ``conv_id`` is a
conversation. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.session import stage_table

BLOCK = 2048                 # turns of a block at most
BLOCK_CHARS = 1 << 23        # characters of a block at most, but for its last turn
STATES = ("", "s", "u", "a")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}       # the role that an inserted or re-roled turn takes
ROLE = {"u": "user", "a": "assistant"}
FOLLOWS = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
LEGAL = ("su", "ua", "au")
DELETE, INSERT, KEEP, REROLE, CUT_OFF = 2, 5, 0, 1, 5
END_COST = {"": (0, ""), "s": (2 * INSERT, "II"), "u": (INSERT, "I"), "a": (0, "")}
BASE, MODULUS = 1_000_003, (1 << 61) - 1
SOLID = "[^\\x20\\x09-\\x0D]"


class Audits:
    """Audits as nodes of a tree; node 0 is the empty audit."""

    def __init__(self, base: int = BASE, modulus: int = MODULUS):
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [()]
        self.base, self.modulus = base, modulus

    def add(self, node: int, edit: str) -> int:
        up, above = [node], self.up
        while True:
            k, at = len(up) - 1, up[-1]
            if len(above[at]) <= k:
                break
            up.append(above[at][k])
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(edit)) % self.modulus)
        self.up.append(tuple(up))
        return len(self.edit) - 1

    def ancestor(self, node: int, depth: int) -> int:
        """The prefix of length ``depth``."""
        gap, k = self.depth[node] - depth, 0
        while gap:
            if gap & 1:
                node = self.up[node][k]
            gap >>= 1
            k += 1
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether audit a comes before audit b."""
        da, db = self.depth[a], self.depth[b]
        n = min(da, db)
        x, y = self.ancestor(a, n), self.ancestor(b, n)
        if self.hash[x] != self.hash[y]:
            for k in range(n.bit_length() - 1, -1, -1):  # down to the first edits that differ
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            first = (x, y)
            x, y = self.up[x][0], self.up[y][0]
        else:
            first = None
        while x != y:  # equal hashes, verified: an earlier difference means that they collided
            if self.edit[x] != self.edit[y]:
                first = (x, y)
            x, y = self.up[x][0], self.up[y][0]
        return da < db if first is None else self.edit[first[0]] < self.edit[first[1]]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _better(audits, best, state, cost, node):
    old = best.get(state)
    if old is None or cost < old[0] or cost == old[0] and audits.less(node, old[1]):
        best[state] = (cost, node)


def _inserted(audits: Audits, best: dict) -> dict:
    """The states reachable with inserted turns too."""
    out, fresh = dict(best), list(best)
    while fresh:
        state = fresh.pop()
        cost, node = out[state]
        to = NEXT[state]
        if to not in out or cost + INSERT <= out[to][0]:
            was = out.get(to)
            _better(audits, out, to, cost + INSERT, audits.add(node, "I"))
            if out[to] != was:
                fresh.append(to)
    return out


def best_audits(turns: list, start: str = "", audits: Audits | None = None) -> tuple[dict, Audits]:
    """Cheapest audits of ``turns`` (initial, must go, cut off) by end state,
    before any insert behind the last turn."""
    audits = audits or Audits()
    best = {start: (0, 0)}
    for initial, gone, cut in turns:
        now: dict = {}
        extra = CUT_OFF if cut else 0
        for state, (cost, node) in _inserted(audits, best).items():
            moves = [(state, DELETE, "D")]
            if not gone:
                if (state, initial) in FOLLOWS:
                    moves.append((initial, KEEP + extra, "K"))
                moves.append((NEXT[state], REROLE + extra, "R"))
            for to, price, edit in moves:
                old = now.get(to)
                if old is None or cost + price <= old[0]:
                    _better(audits, now, to, cost + price, audits.add(node, edit))
        best = now
    return best, audits


def _ended(best: dict, ranks: dict) -> tuple[int, str, str]:
    """(cost, end state, inserts behind the last turn) of the cheapest audit;
    ``ranks`` orders the end states' audits, none of which is a prefix of another."""
    cost, _, state, more = min((c + END_COST[s][0], ranks[s], s, END_COST[s][1]) for s, c in best.items())
    return cost, state, more


def _ranks(audits: Audits, best: dict) -> dict:
    order: list = []
    for s, (_, node) in best.items():
        at = 0
        while at < len(order) and audits.less(best[order[at]][1], node):
            at += 1
        order.insert(at, s)
    return {s: i for i, s in enumerate(order)}


def repaired_turns(turns, audit: str):
    """``role:text`` lines of (role, text) turns under an audit."""
    turns, state = iter(turns), ""
    for edit in audit:
        role, text = next(turns) if edit != "I" else ("", "")
        if edit == "D":
            continue
        state = role[:1] if edit == "K" else NEXT[state]
        yield f"{role if edit == 'K' else ROLE[state]}:{text}"


class Digest:
    """SHA-256 of lines joined with newlines."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, line: str):
        self.sha.update((b"\n" if self.any else b"") + line.encode())
        self.any = True


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """Turns after the damage (``copies`` 0: dropped), equal ones counted."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                text("role").alias("role"), text("text").alias("text"), code.alias("code"))
    gone = F.col("code") == 0
    rows = rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") <= 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def _sorted_turns(turns: DataFrame) -> DataFrame:
    """All turns with their faults, range-sorted by conversation and turn."""
    digest = F.sha2(F.col("text"), 256)
    some = turns.where(F.col("copies") > 0).withColumn("digest", digest)
    # the first of those turns that say the same more than once under different numbers; a written table, so a join to it
    # may be split where one of them has very many
    again = stage_table(some.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("first"), F.count(F.lit(1)).alias("n")).where(
        F.col("n") > 1).select(F.col("conv_id").alias("c2"), F.col("role").alias("r2"), F.col("digest").alias("d2"), "first"), "again")
    both = turns.withColumn("digest", digest).join(again, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("role") == F.col("r2")) & (
        F.col("digest") == F.col("d2")) & (F.col("copies") > 0), "left")
    blank = ~F.col("text").rlike(SOLID)
    order = ["conv_id", "turn", "role", "text"]
    return both.select(*order, "copies", blank.alias("blank"), (
        F.col("d2").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))).alias("again"),
        (~blank & ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("cut"))


COUNTS = ["distinct", "blank", "duplicate", "truncated", "illegal"]
ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()),
         "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
PIECES = {"whole": "boolean", "conv_id": "bigint", "part": "int", "block": "bigint", "low": "bigint", "high": "bigint",
          **dict.fromkeys(COUNTS, "bigint"), "first": "string", "last": "string", "first_turn": "bigint", "starts": "array<int>",
          "ends": "array<int>", "costs": "array<bigint>", "ranks": "array<int>", "audits": "array<string>", "sha": "string"}
CHOSEN = {"conv_id": "bigint", "part": "int", "block": "bigint", "pick": "int", "more": "string",
          **dict.fromkeys(["gaps", *COUNTS[1:], "cost"], "bigint")}


def _ddl(fields: dict) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields.items())


def _rows(rows: list, fields: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, ARROW[t]) for n, t in fields.items()]))


class Block:
    """Turns of one conversation that follow one another."""

    def __init__(self):
        self.turns, self.lines, self.chars = [], [], 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.first_turn = self.first = self.last = None

    def add(self, turn, role, text, blank, again, cut):
        if turn is not None:
            if self.low is None:
                self.low = self.first_turn = turn
            self.counts["distinct"] += turn != self.high
            self.high = turn
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.counts["illegal"] += self.last + initial not in LEGAL
        self.last = initial
        self.turns.append((initial, blank or again, bool(cut) and not again))
        self.lines.append((role, text))
        self.chars += len(text)

    def row(self, whole: bool, conv, part, number):
        out = {"whole": whole, "conv_id": conv, "part": part, "block": number, "low": self.low, "high": self.high,
               **self.counts, "first": self.first, "last": self.last, "first_turn": self.first_turn,
               "starts": [], "ends": [], "costs": [], "ranks": [], "audits": [], "sha": None}
        if whole:
            best, audits = best_audits(self.turns)
            cost, state, more = _ended({s: c for s, (c, _) in best.items()}, _ranks(audits, best))
            audit, digest = audits.text(best[state][1]) + more, Digest()
            for line in repaired_turns(self.lines, audit):
                digest.add(line)
            return out | {"costs": [cost], "audits": [audit], "sha": digest.sha.hexdigest()}
        for s in STATES:
            best, audits = best_audits(self.turns, s)
            ranks = _ranks(audits, best)
            for t, (cost, node) in best.items():
                out["starts"].append(STATES.index(s))
                out["ends"].append(STATES.index(t))
                out["costs"].append(cost)
                out["ranks"].append(ranks[t])
                out["audits"].append(audits.text(node))
        return out


def _repair_batches(block_turns: int):
    def run(batches):
        part, block, conv, number, rows = TaskContext.get().partitionId(), None, None, 0, []
        opened = True            # the conversation may have begun in the partition before

        def close(last):
            nonlocal block, number
            rows.append(block.row(not (opened or last or number), conv, part, number))
            number += 1
            block = Block()

        def flush():
            out = _rows(rows, PIECES)
            rows.clear()
            return out

        for batch in batches:
            for c, turn, role, text, copies, blank, again, cut in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if block is None or c != conv:
                    if block is not None:
                        close(False)
                        opened = False
                    block, conv, number = Block(), c, 0
                for k in range(copies):
                    if len(block.turns) >= block_turns or block.chars > BLOCK_CHARS:
                        rows.append(block.row(False, conv, part, number))
                        number += 1
                        block = Block()
                    block.add(turn, role, text, blank, again or k > 0, cut)
            if len(rows) > 256:
                yield flush()
        if block is not None:
            close(True)
        if rows:
            yield flush()
    return run


def _put_together(table: pa.Table) -> pa.Table:
    """One conversation's block tables (no audits among them): which of its audits each block takes, and the counts."""
    every = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
    rows = [r for r in every if r["first"] is not None]
    best, steps = {0: (0, 0)}, []          # state -> (cost, rank of its audit)
    total = dict.fromkeys(COUNTS, 0)
    low = high = last = None
    for r in rows:
        for c in COUNTS:
            total[c] += r[c]
        if last is not None:
            total["illegal"] += last + r["first"] not in LEGAL
        last = r["last"]
        if r["low"] is not None:
            total["distinct"] -= r["first_turn"] == high
            low = r["low"] if low is None else low
            high = r["high"]
        now: dict = {}
        for i, (s, t, cost, rank) in enumerate(zip(r["starts"], r["ends"], r["costs"], r["ranks"], strict=True)):
            if s in best:  # a prefix from another start decides before what follows it
                key = (best[s][0] + cost, best[s][1], rank)
                if t not in now or key < now[t][0]:
                    now[t] = (key, i)
        order = sorted(now, key=lambda t: now[t][0][1:])
        steps.append({t: i for t, (_, i) in now.items()})
        best = {t: (now[t][0][0], n) for n, t in enumerate(order)}
    cost, state, more = _ended({STATES[s]: c for s, (c, _) in best.items()}, {STATES[s]: k for s, (_, k) in best.items()})
    picks, at = [], STATES.index(state)
    for r, step in zip(reversed(rows), reversed(steps), strict=True):
        picks.append(step[at])
        at = r["starts"][step[at]]
    total["cost"], total["gaps"] = cost, 0 if low is None else high - low + 1 - total["distinct"]
    out = [{"conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "pick": p, "more": None, **total}
           for r, p in zip(rows, reversed(picks), strict=True)]
    out = out or [{"conv_id": every[0]["conv_id"], "part": every[0]["part"], "block": every[0]["block"], "pick": -1, **total}]
    out[-1]["more"] = more
    return pa.Table.from_batches([_rows(out, CHOSEN)])


def _digest_batches(batches):
    """A stream sorted by conversation, the pieces of its audit before its turns."""
    now, rows = None, []

    def finish():
        for edit in now["todo"]:  # inserts behind the last turn
            step(edit, "", "")
        return (now["conv"], now["audit"], now["digest"].sha.hexdigest())

    def step(edit, role, text):
        if edit == "D":
            return
        now["state"] = role[:1] if edit == "K" else NEXT[now["state"]]
        now["digest"].add(f"{role}:{text}" if edit == "K" else f"{ROLE[now['state']]}:{text}")

    def frame():
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*rows), [pa.int64(), pa.string(), pa.string()], strict=True)], ["conv_id", "audit", "sha"])
        rows.clear()
        return out

    for batch in batches:
        for conv, kind, audit, role, text, copies in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "kind", "audit", "role", "text", "copies")), strict=True):
            if now is None or now["conv"] != conv:
                if now is not None:
                    rows.append(finish())
                now = {"conv": conv, "pieces": [], "audit": None, "digest": Digest(), "state": "", "todo": iter("")}
            if kind == 0:
                now["pieces"].append(audit)
                continue
            if now["pieces"]:
                now["audit"] = "".join(now["pieces"])
                now["pieces"], now["todo"] = [], iter(now["audit"])
            for _ in range(copies):
                for edit in now["todo"]:
                    if edit != "I":
                        step(edit, role, text)
                        break
                    step(edit, "", "")
        if len(rows) > 256:
            yield frame()
    if now is not None:
        rows.append(finish())
    if rows:
        yield frame()


def repair_conversations(conversations: DataFrame, block_turns: int = BLOCK) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256."""
    turns = stage_table(damaged_turns(conversations), "turns")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = _sorted_turns(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stage_table(ranged.mapInArrow(_repair_batches(block_turns), _ddl(PIECES)), "repairs")
    whole = pieces.where("whole").select(
        "conv_id", (F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("distinct"))).alias("gaps"),
        *COUNTS[1:], F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), F.col("sha").alias("repaired_sha256"))
    cut = pieces.where("not whole")
    chosen = stage_table(cut.drop("audits", "sha", "whole").groupBy("conv_id").applyInArrow(_put_together, _ddl(CHOSEN)), "chosen")
    audits = chosen.select("conv_id", "part", "block", "pick", "more").join(
        cut.select(F.col("conv_id").alias("c2"), F.col("part").alias("p2"), F.col("block").alias("b2"), "audits"),
        F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("part") == F.col("p2")) & (F.col("block") == F.col("b2")), "left").select(
        "conv_id", F.lit(0).alias("kind"), F.concat(
            F.when(F.col("pick") >= 0, F.get("audits", F.col("pick"))).otherwise(""), F.coalesce("more", F.lit(""))).alias("audit"),
        "part", "block", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
        F.lit(0).cast("bigint").alias("copies"))
    own = chosen.select(F.col("conv_id").alias("c3")).distinct()
    stream = audits.unionByName(turns.join(own, F.col("conv_id").eqNullSafe(F.col("c3")), "left_semi").select(
        "conv_id", F.lit(1).alias("kind"), F.lit("").alias("audit"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("block"),
        "turn", "role", "text", "copies"))
    sha = stream.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "block", F.col("turn").asc_nulls_first(), "role", "text")
    sha = sha.mapInArrow(_digest_batches, "conv_id bigint, audit string, sha string").select(
        F.col("conv_id").alias("c4"), "audit", F.col("sha").alias("repaired_sha256"))
    rest = chosen.where(F.col("more").isNotNull()).join(sha, F.col("conv_id").eqNullSafe(F.col("c4")))
    names = whole.columns
    return whole.unionByName(rest.select(*names))
