"""Secret scan: known forms by pattern, and unknown ones by sliding-window Shannon entropy.

Candidate strings are runs of characters that keys are made of, of at least WINDOW characters, with a digit
and a letter; in a class, only runs of it with a digit. Long words and names have no digits, and would be spans
without this rule; a key without one, or shorter than a window, is so found by the known forms only. Over a candidate slides a window of WINDOW characters; its counts are changed by one
character out and one in, and the sum of c*log2(c), from which the entropy follows, with them. For a
character class (hex digits, base64, any of the candidate characters) the windows that consist of it are
held against the class's threshold; overlapping windows above theirs make one span, cut to the candidate.
A span is suppressed if its candidate is on the allow-list (patterns of harmless strings), or if spans
of the known forms cover it.

Positions are code points, ends exclusive. Whole texts are scanned.

Defined cases: a null text is an empty one, without spans; repeated rows are scanned each; ids may be
null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tandemql.llm.common import map_arrow, pick

# The forms of the contract. (kind, pattern, group that has a least length, that length)
KNOWN = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.ASCII | re.IGNORECASE),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, re.ASCII),
    ("hex", r"[0-9a-f]+", 0, 16, re.ASCII),
]

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least bits a character that a window of the class has to have.
CLASSES = [("hex", re.compile(r"[0-9a-fA-F]+"), 3.0), ("base64", re.compile(r"[A-Za-z0-9+/=]+"), 3.6), ("key", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.8)]
#: Candidates that look random but are no secrets: UUIDs, digit runs, dates, words joined by dashes or slashes.
ALLOWED = [
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9+/_=-]+",
    r"(?:[A-Za-z]+[0-9]{0,4}[+/_=-]+)*[A-Za-z]+[0-9]{0,4}[+/_=-]*",
]
ALWAYS = "entropy"

Span = tuple[str, int, int]


def _patterns() -> list[tuple[str, re.Pattern, int, int]]:
    # A run of 16 is matched as one; in "assign" a match that is too short still uses up its characters.
    fast = {"hex": r"[0-9a-f]{16,}", "access": r"AKIA[A-Z0-9]{14,}"}
    return [(kind, re.compile(fast.get(kind, pattern), flags), group, least) for kind, pattern, group, least, flags in KNOWN]


_READY = _patterns()
_CANDIDATE = re.compile(CANDIDATE)
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_ALLOWED = re.compile("|".join(f"(?:{a})" for a in ALLOWED))
_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def known_spans(text: str) -> list[Span]:
    found = []
    for kind, pattern, group, least in _READY:
        if kind == "access" and "AKIA" not in text or kind == "assign" and ":" not in text and "=" not in text:
            continue
        found += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def window_entropies(s: str, width: int = WINDOW) -> Iterator[float]:
    """Bits a character of each window of ``s``, by counts that are changed by the two characters that differ."""
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(s):
        if i >= width:  # one out before one in, as a window has ``width`` of a character at most
            out = s[i - width]
            n = counts[out]
            total -= _TERM[n] - _TERM[n - 1]
            counts[out] = n - 1
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        if i >= width - 1:
            yield math.log2(width) - total / width


def entropy_spans(text: str, allowed: re.Pattern = _ALLOWED) -> list[Span]:
    found = []
    for m in _CANDIDATE.finditer(text):
        s, base = m.group(), m.start()
        if not (_DIGIT.search(s) and _LETTER.search(s)) or allowed.fullmatch(s):
            continue
        high: list[tuple[int, int]] = []
        for _, members, least in CLASSES:
            for run in members.finditer(s):
                if run.end() - run.start() >= WINDOW and _DIGIT.search(run.group()):
                    high += [(run.start() + i, run.start() + i + WINDOW) for i, bits in enumerate(window_entropies(run.group())) if bits >= least]
        for a, b in sorted(high):
            if found and found[-1][2] >= base + a and found[-1][1] >= base:
                found[-1] = (ALWAYS, found[-1][1], max(found[-1][2], base + b))
            else:
                found.append((ALWAYS, base + a, base + b))
    return found


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(known spans, all spans), both by start, then kind as listed."""
    rank = {kind: i for i, (kind, *_) in enumerate(KNOWN)}
    order = lambda s: (s[1], rank.get(s[0], len(rank)))
    base = sorted(known_spans(text), key=order)
    new = [s for s in entropy_spans(text) if not any(a <= s[1] and s[2] <= b for _, a, b in base)]
    return base, sorted(base + new, key=order)


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        cols: list[list] = [[] for _ in range(6)]
        for text in part.column(1).to_pylist():
            base, spans = all_spans(text or "")
            kinds = [s[0] for s in spans]
            row = [*(kinds.count(k) for k in ("assign", "access", "hex", ALWAYS)), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans)]
            for col, value in zip(cols, row, strict=True):
                col.append(value)
        types = [pa.int64()] * 4 + [pa.string()] * 2
        arrays = [part.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCANNED.split(", ")])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: counts by kind, the digest of the known spans, and all spans as text. No shuffle."""
    return map_arrow(pick(docs, doc_id=id_col, text=text_col), _scan, SCANNED)
