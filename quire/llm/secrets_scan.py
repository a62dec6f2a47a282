"""Secret scan over a trigram inverted index.

Each rule's regular expression is parsed once into a Boolean trigram query (what trigrams any match must contain). The
index is kept per segment, a segment being a bounded slice of a batch of documents: postings lists (trigram -> document
ordinals) of every trigram of the ASCII-lower-cased texts (``TrigramIndex``). A query is evaluated by intersecting and
uniting postings, and only its candidates are verified with the regular expression; a rule without mandatory trigrams is
run over every document. Segments are independent, so nothing is shuffled and a lost executor costs its segments only.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as sc
from re import _parser as sp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ALL, NONE = ("all",), ("none",)
_MOST_STRINGS = 24


@dataclass(frozen=True)
class Rule:
    """kind: name of the spans. pattern: leftmost non-overlapping matches. least: characters that the match (group 0), or the group, must have."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The base rules, in the order in which ties are listed.
BASE = (
    Rule("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Rules that the method adds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@"),
)


def _and(a: tuple, b: tuple) -> tuple:
    if NONE in (a, b):
        return NONE
    return b if a == ALL else a if b == ALL or a == b else ("and", a, b)


def _or(a: tuple, b: tuple) -> tuple:
    if ALL in (a, b):
        return ALL
    return b if a == NONE else a if b == NONE or a == b else ("or", a, b)


def _of_string(s: str) -> tuple:
    q: tuple = ALL
    for i in range(len(s) - 2):
        q = _and(q, ("tri", s[i : i + 3]))
    return q


def _of_strings(strings: set[str]) -> tuple:
    q: tuple = NONE
    for s in sorted(strings):
        q = _or(q, _of_string(s))
    return q


class _Info:
    """Of a part of an expression: the finite set of strings it matches, or None; and the query that any match satisfies."""

    def __init__(self, strings: set[str] | None, query: tuple = ALL) -> None:
        self.strings, self.query = strings, query

    def closed(self) -> tuple:
        return _and(self.query, _of_strings(self.strings)) if self.strings is not None else self.query


def _chars(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sc.LITERAL:
            out.add(chr(arg).lower())
        elif op is sc.RANGE and arg[1] - arg[0] < 3:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 3 else None


def _info(parsed) -> _Info:
    run: set[str] | None = {""}
    query: tuple = ALL

    def close() -> None:
        nonlocal query, run
        if run is not None:
            query = _and(query, _of_strings(run))
        run = {""}

    for op, arg in parsed:
        if op is sc.LITERAL:
            part = _Info({chr(arg).lower()}) if arg < 128 else _Info(None)
        elif op is sc.IN:
            part = _Info(_chars(arg))
        elif op is sc.SUBPATTERN:
            part = _info(arg[-1])
        elif op is sc.BRANCH:
            subs = [_info(x) for x in arg[1]]
            if all(x.strings is not None and x.query == ALL for x in subs) and sum(len(x.strings) for x in subs) <= _MOST_STRINGS:
                part = _Info(set().union(*(x.strings for x in subs)))
            else:
                q: tuple = NONE
                for x in subs:
                    q = _or(q, x.closed())
                part = _Info(None, q)
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
            low, high, body = arg
            sub = _info(body)
            if (low, high) == (0, 1) and sub.strings is not None and sub.query == ALL:
                part = _Info(sub.strings | {""})
            else:
                part = _Info(None, sub.closed() if low else ALL)
        else:  # a class that is not listed, an anchor, a look-around: nothing is known
            part = _Info(None)
        query = _and(query, part.query)
        if part.strings is None:
            close()
        elif len(run) * len(part.strings) > _MOST_STRINGS:
            close()
            run = set(part.strings)
        else:
            run = {x + y for x in run for y in part.strings}
    if query == ALL and run is not None:
        return _Info(run)
    close()
    return _Info(None, query)


def trigram_query(pattern: str) -> tuple:
    """("all",) | ("tri", t) | ("and", p, q) | ("or", p, q): what the ASCII-lower-cased text of any match must contain."""
    return _info(sp.parse(pattern)).closed()


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


class TrigramIndex:
    """Inverted index of a segment: for every trigram of its texts' bytes (A-Z lower-cased) the ordinals of the texts, ascending."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        b = _FOLD[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        if len(b) < 3:
            self.keys, self.docs, self.starts = (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(1, dtype=np.int64),)
            return
        tri = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]).astype(np.uint64)
        doc = np.repeat(np.arange(len(raw), dtype=np.uint64), size)
        inside = doc[:-2] == doc[2:]  # a trigram does not cross into the next text
        both = np.unique(tri[inside] << np.uint64(32) | doc[:-2][inside])
        key = (both >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        self.keys, self.docs, self.starts = key[first], (both & np.uint64(0xFFFFFFFF)).astype(np.int64), np.r_[first, len(key)]

    def postings(self, trigram: str) -> np.ndarray:
        a, b, c = trigram.encode()
        i = int(np.searchsorted(self.keys, a << 16 | b << 8 | c))
        if i == len(self.keys) or self.keys[i] != a << 16 | b << 8 | c:
            return np.zeros(0, dtype=np.int64)
        return self.docs[self.starts[i] : self.starts[i + 1]]


def _evaluate(q: tuple, index: TrigramIndex) -> np.ndarray:
    if q[0] == "tri":
        return index.postings(q[1])
    a, b = _evaluate(q[1], index), _evaluate(q[2], index)
    return np.intersect1d(a, b, assume_unique=True) if q[0] == "and" else np.union1d(a, b)


def scan(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text of a segment, (start, rule number, end) of every span, in order."""
    compiled = [re.compile(r.pattern) for r in rules]
    queries = [trigram_query(r.pattern) for r in rules]
    index = TrigramIndex(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, rx, q) in enumerate(zip(rules, compiled, queries, strict=True)):
        if rule.group == 0 and rule.least > 1 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
            rx = re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}")  # of a run of one class the long ones only, the same spans
        for i in range(len(texts)) if q == ALL else _evaluate(q, index).tolist():
            for m in rx.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found[i].append((m.start(), k, m.end()))
    for x in found:
        x.sort()
    return found


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: int = len(BASE), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n array<long> per rule, spans array<struct<kind, start, end>>, base_sha256).

    Offsets are code points, ends exclusive; spans come by start, then by the rules' order. base_sha256 is the hex digest
    of kind:start:end of the first `base` rules' spans, comma-joined. A null text counts as empty: no spans.
    """
    kinds = [r.kind for r in rules]

    def run(batches):
        for part, texts in (x for batch in batches for x in slices(batch)):
            texts = [t or "" for t in texts]
            found = scan(texts, rules)
            n = [[sum(k == j for _, k, _ in x) for j in range(len(rules))] for x in found]
            spans = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in x] for x in found]
            sha = [hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in x if k < base).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), pa.array(sha, pa.string())], names=[id_col, "n", "spans", "base_sha256"])

    src = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, n array<long>, spans array<struct<kind:string,start:long,end:long>>, base_sha256 string")
