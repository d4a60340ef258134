"""Secret scan: fixed patterns and sliding-window entropy.

Three kinds of pattern are always reported: assignments to a telling name,
access keys, and long hex strings.  Beside them every candidate string (a
long run of key characters) is scanned with a window of ``window`` characters
whose Shannon entropy is kept up to date from counts as it slides.  A window is
suspicious if its entropy reaches the threshold of its character class; touching
suspicious windows are joined into one ``entropy`` span.  The counts by class are
kept up to date in the same way.  Spans whose part of the candidate (between
slashes and equals signs) matches an allow-list pattern, candidates that are
as a whole an id or a path of words, and spans inside a reported pattern are
left out.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import map_arrow, slices, text_of

KINDS = ("assign", "access", "hex", "entropy")
# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20

# An assignment has one of these before anything else is tried on a text.
_NAMES = re.compile(r"pass|secret|token|api", re.A | re.I)
# Candidates shorter than the window are one window of their own length, down to this one.
LEAST = 16
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
WINDOW = 20
# Bits by class of the window's characters, for a window of 20.  Letters alone
# need more than words run together reach: nearly what random letters of one case, or of both, have;
# digits alone are numbers, never secrets.
THRESHOLDS = {"hex": 3.0, "upper_digits": 3.5, "lower_digits": 3.5, "mixed": 3.7, "both_cases": 3.9, "one_case": 3.85}
# Classes in which a shorter window tells nothing: long words are as varied.
WHOLE_WINDOW = ("both_cases", "one_case")
# Parts that look random but are not secret: placeholders, runs of the alphabet.
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|x{6,}",
    r"(?i)abcdefghij|0123456789",
)
# Candidates that are no secret as a whole: ids with dashes, paths of words.
ALLOWED_WHOLE = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|/?([A-Za-z]{1,15}[/_-])+[A-Za-z]{1,15}/?")

# Classes of characters: lower case to f and beyond, upper case to F and beyond, digits, others.
_CLASS = {c: 0 if c <= "f" else 1 for c in "abcdefghijklmnopqrstuvwxyz"} | {
    c: 2 if c <= "F" else 3 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | dict.fromkeys("0123456789", 4)
_OTHER = 5


def _kind_of(counts: list[int]) -> str | None:
    """Character class of a window, from its counts by class of character."""
    lower, upper, digits, others, high = counts[0] + counts[1], counts[2] + counts[3], counts[4], counts[5], counts[1] + counts[3]
    if not lower + upper:
        return None
    if not digits:
        return "both_cases" if lower and upper else "one_case"
    if not others and not high and not (lower and upper):
        return "hex"
    if not others and not lower:
        return "upper_digits"
    if not others and not upper:
        return "lower_digits"
    return "mixed"


@lru_cache
def _steps(size: int) -> list[float]:
    """What the sum of n log2 n gains when a count goes from n to n + 1."""
    held = [0.0, *[n * math.log2(n) for n in range(1, size + 2)]]
    return [b - a for a, b in zip(held, held[1:])]


def entropy_spans(candidate: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Spans of a candidate covered by suspicious windows.  Counts change by one
    character in and one out at each step; the entropy of a window follows from
    the sum of n log2 n over them."""
    spans: list[list[int]] = []
    size = min(window, len(candidate))
    # a shorter window cannot reach the bits of a longer one: thresholds in the same proportion
    scale = math.log2(size) / math.log2(window) if size > 1 else 1.0
    counts: dict[str, int] = {}
    classes, total, steps = [0] * 6, 0.0, _steps(size)
    for end, c in enumerate(candidate, 1):
        n = counts.get(c, 0)
        total += steps[n]
        counts[c] = n + 1
        classes[_CLASS.get(c, _OTHER)] += 1
        if end > size:
            out = candidate[end - size - 1]
            n = counts[out] - 1
            total -= steps[n]
            counts[out] = n
            classes[_CLASS.get(out, _OTHER)] -= 1
        if end >= size:
            kind = _kind_of(classes)
            if size < window and kind in WHOLE_WINDOW:
                kind = None
            if kind and math.log2(size) - total / size >= scale * thresholds[kind] - 1e-9:
                if spans and end - size <= spans[-1][1]:
                    spans[-1][1] = end
                else:
                    spans.append([end - size, end])
    return [(a, b) for a, b in spans]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    if _NAMES.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def added_spans(text: str, base: list[tuple[str, int, int]], window: int, allowed: re.Pattern | None) -> list[tuple[str, int, int]]:
    """Entropy spans outside the base spans and the allow-list."""
    out = []
    for m in _CANDIDATE.finditer(text):
        if ALLOWED_WHOLE.fullmatch(m[0]):
            continue
        for a, b in entropy_spans(m[0], window):
            if allowed is not None and allowed.search(_part(m[0], a, b)):
                continue
            a, b = a + m.start(), b + m.start()
            if not any(s <= a and b <= e for _, s, e in base):
                out.append(("entropy", a, b))
    return out


def _part(candidate: str, a: int, b: int) -> str:
    """The part of a candidate, between slashes and equals signs, that most of the span lies in."""
    cuts = [-1, *[i for i, c in enumerate(candidate) if c in "/="], len(candidate)]
    return max((candidate[s + 1:e] for s, e in zip(cuts, cuts[1:]) if s < b and e > a),
               key=lambda p: len(p), default=candidate[a:b])


def joined(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """One row per input row: ``doc_id``, ``base`` and ``added`` (arrays of kind,
    start, end in code points, end exclusive), ``base_text`` and ``spans`` (the
    same as ``kind:start:end`` lists; ``spans`` holds both).

    A null text counts as empty and has no span.  Repeated rows each get a row.
    A very long text is searched whole, a long candidate in one pass; touching
    windows of equal entropy are one span.  An empty table gives no rows.  Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    allow = "|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in allowed)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def of(batches):
        listed = re.compile(allow) if allow else None
        for batch in slices(batches):
            base = [base_spans(t) for t in batch.column("text").to_pylist()]
            added = [added_spans(t, b, window, listed) for t, b in zip(batch.column("text").to_pylist(), base)]
            spans = lambda rows: pa.array([[dict(zip(("kind", "start", "end"), s)) for s in r] for r in rows], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), spans(base), spans(added), pa.array([joined(b) for b in base], pa.string()),
                 pa.array([joined(b + a) for b, a in zip(base, added)], pa.string())],
                names=["doc_id", "base", "added", "base_text", "spans"])

    one = "array<struct<kind:string,start:long,`end`:long>>"
    return map_arrow(rows, of, f"doc_id long, base {one}, added {one}, base_text string, spans string")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base list, and all spans."""
    def n(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", n("assign"), n("access"), n("hex"),
                        F.sha2("base_text", 256).alias("base_sha256"), "spans")


