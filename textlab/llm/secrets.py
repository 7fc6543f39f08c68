"""Secret scans: fixed patterns, and passwords by guess cost.

Base kinds: ``assign`` (a credential word, a colon or equals sign, a value),
``access`` (access-key ids), ``hex`` (long runs of hexadecimal digits).

Method: values in a credential context (a wider list of words) are cut into
words, dates, repeats, keyboard walks and brute-force characters by dynamic
programming; the segmentation with the least total cost, in powers of ten of
guesses, is what a guesser would need. A value that costs ``MIN_GUESSES`` or
more and does not lie within a base span is a span of kind ``password``.

One Arrow pass without a shuffle. A linear-time filter first finds the texts
that hold any of the words or patterns; only these are searched further. Whole
texts are searched; the cost of a value of n characters is n times a constant.

Null and empty texts have no spans. Repeated rows are scanned alike; null ids
pass through. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "password")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
# any text with a span matches this; a linear-time engine reads all texts
LIKELY = r"(?i:pass|secret|token|api_?key|pwd|login|credential|auth)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|login|credentials?|auth(?:_?key)?)["']?\x20*[:=]\x20*"""
    r"""(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"']{6,}))""", re.A | re.I)
LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
MIN_GUESSES = 10.0
# a small ranked list of words common in passwords; a larger one may be given
WORDS = ("password pass admin welcome login user test master dragon monkey letmein football baseball shadow sunshine "
         "princess secret love hello summer winter spring autumn monday friday change changeme default root qwerty "
         "token example sample demo guest public private access key server database system manager company office "
         "home house family money magic power super star light dark night day blue red green black white").split()
ROWS_OF_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("013457@$!", "oleastasi")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
                  r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
DATE_COST = {4: math.log10(120)}
FULL_DATE = math.log10(120 * 366 * 4)
STEP_COST = math.log10(2)  # per segment: where it starts is not known


def _char_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isalpha():
        return math.log10(26) if c.isascii() else 2.0
    return math.log10(33) if c.isascii() else 2.0


def _walk_steps():
    return {a + b for row in ROWS_OF_KEYS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]}


def guess_cost(value: str, words=WORDS) -> float:
    """log10 of the guesses that the cheapest segmentation of a value needs."""
    rank = {w: i + 1 for i, w in enumerate(words)}
    longest = max(map(len, rank), default=0)
    steps = _walk_steps()
    lower = value.lower()
    if len(lower) != len(value):  # a character whose lower case is longer: compare as it stands
        lower = value
    plain = lower.translate(LEET)
    n = len(value)
    best = [0.0] + [math.inf] * n
    brute = [False] * (n + 1)          # the best way to i ends in a brute-force span
    dates: dict[int, list] = {}
    for m in DATE.finditer(value):     # the date pattern at any digit
        dates.setdefault(m.start(), []).append(m.end())
    for i in range(n):
        if i and value[i].isdigit() and i not in dates and (m := DATE.match(value, i)):
            dates[i] = [m.end()]
    run = walk = 0
    for i in range(1, n + 1):
        c = value[i - 1]
        # brute force: one more character, a new span costs a step
        cost = best[i - 1] + _char_cost(c) + (0.0 if brute[i - 1] or i == 1 else STEP_COST)
        if cost < best[i]:
            best[i], brute[i] = cost, True
        # words, also capitalised and with digits for letters
        for j in range(max(0, i - longest), i):
            w = lower[j:i]
            r = rank.get(w) or rank.get(plain[j:i])
            if r:
                extra = (math.log10(2) if value[j:i] != w else 0) + (math.log10(4) if w not in rank else 0)
                cost = best[j] + math.log10(r + 1) + extra + STEP_COST
                if cost < best[i]:
                    best[i], brute[i] = cost, False
        # repeats and keyboard walks of three characters or more end here
        run = run + 1 if i > 1 and c == value[i - 2] else 1
        walk = walk + 1 if i > 1 and lower[i - 2:i] in steps else 1
        for length, base in ((run, _char_cost(c)), (walk, math.log10(94))):
            if length >= 3:
                cost = best[i - length] + base + math.log10(length) + STEP_COST
                if cost < best[i]:
                    best[i], brute[i] = cost, False
        for end in dates.get(i - 1, ()):
            cost = best[i - 1] + DATE_COST.get(end - i + 1, FULL_DATE) + STEP_COST
            if cost < best[end]:
                best[end], brute[end] = cost, False
    return best[n]


def scan_text(text: str, words=WORDS) -> tuple[list, float | None]:
    """All spans (start, kind, end) in order, and the highest guess cost of a context value."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]  # whole runs: a run is maximal either way
    top, base = None, list(found)
    for m in CONTEXT.finditer(text):
        g = m.lastindex
        cost = guess_cost(m[g], words)
        top = cost if top is None else max(top, cost)
        if cost >= MIN_GUESSES and not any(s <= m.start(g) and m.end(g) <= e for s, _, e in base):
            found.append((m.start(g), 3, m.end(g)))
    return sorted(found), top


FIELDS = [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
          ("n_password", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("top_cost", pa.float64())]


def _named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan_batches(words):
    def run(batches):
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            text = batch.column("text")
            hit = pc.fill_null(pc.match_substring_regex(text, LIKELY), False)
            counts = [[0] * n for _ in KINDS]
            sha, spans, top = [empty] * n, [""] * n, [None] * n
            for i in pc.indices_nonzero(hit).to_pylist():
                found, top[i] = scan_text(text[i].as_py(), words)
                for _, k, _ in found:
                    counts[k][i] += 1
                sha[i] = hashlib.sha256(_named([x for x in found if x[1] < 3]).encode()).hexdigest()
                spans[i] = _named(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()),
                 pa.array(spans, pa.string()), pa.array(top, pa.float64())], schema=pa.schema(FIELDS))
    return run


def secret_spans(docs: DataFrame, words=tuple(WORDS)) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans
    ``kind:start:end`` by start, and the highest guess cost seen."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_scan_batches(words), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
                           "n_password bigint, base_sha256 string, spans string, top_cost double")
