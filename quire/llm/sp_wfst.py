"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into three transducers over the tropical semiring: the normaliser (white space escape, dummy
prefix), the piece transducer (one path per piece, weight minus its score) and byte fallback (any other character, spelt
as its UTF-8 bytes). An input is composed with them lazily, giving a lattice of its pieces, and the shortest path is the
encoding.

For unigram models that is the whole story. A BPE model's encoding is not the path of least score, but it is known to be
the only path on which every two neighbouring pieces are compatible, i.e. on which undoing merges at the seam never
shows a merge that would have come earlier. So for BPE the lattice is composed with a third automaton whose state is the
last piece and whose transitions are the compatible pairs; one path is left for every prefix, and it is the shortest.

White space is escaped before pieces are looked for and no piece has an escape behind other characters, so the lattice
falls apart at escapes that follow something else, and parts are remembered (within a bound).
"""

from __future__ import annotations

import gc
import re
import struct
import zlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ESC = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    r = k = 0
    while True:
        c = b[i]
        i, r, k = i + 1, r | (c & 127) << k, k + 7
        if c < 128:
            return r, i


def _fields(b: bytes):
    """(number, value) of a protocol-buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


class Model:
    """What a model file says: pieces, scores, kinds and the normaliser's switches."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.bpe, self.dummy_prefix, self.strip, self.charsmap = False, True, True, b""
        for number, v in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, x in _fields(v):
                    if k == 1:
                        piece = x.decode()
                    elif k == 2:
                        score = struct.unpack("<f", x)[0]
                    elif k == 3:
                        kind = x
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                self.bpe = dict(_fields(v)).get(3, 1) == 2
            elif number == 3:
                n = dict(_fields(v))
                self.charsmap, self.dummy_prefix, self.strip = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1))
        if self.charsmap:
            raise ValueError("models with a precompiled character map are not supported; use one with the identity normaliser")
        self.unk = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0


class Transducer:
    """The compiled transducers of a model, composed with one input at a time."""

    def __init__(self, model: Model) -> None:
        self.model = model
        use = [i for i, k in enumerate(model.kinds) if k in (NORMAL, USER)]
        self.id = {model.pieces[i]: i for i in use}
        self.bytes = {int(model.pieces[i][3:5], 16): i for i, k in enumerate(model.kinds) if k == BYTE}
        self.tail_escape = any(ESC in p.lstrip(ESC) for p in self.id)
        chars = {c for p in self.id for c in p}
        self.breaks = "\n" not in chars
        self.unit = re.compile(f"\n|{ESC}*[^{ESC}\n]+|{ESC}+" if self.breaks else f"{ESC}*[^{ESC}]+|{ESC}+") if not self.tail_escape else re.compile("(?s).+")
        if model.bpe:
            self._splits()
        self.lattice = ahocorasick.Automaton()  # the piece transducer, determinised over suffixes
        for piece, i in self.id.items():
            if not (model.bpe and i in self.dead):
                self.lattice.add_word(piece, (i, len(piece)))
        self.lattice.make_automaton()
        self.memory = _Parts(self.path)
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.high = frozenset(i for i, b in self.byte_of.items() if b > 127)  # bytes that spell nothing alone
        spell = {UNKNOWN: " ⁇ ", CONTROL: ""}
        self.spelt = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else spell.get(k, p) for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True))]
        self.pairs: dict[int, bool] = {}

    # --- BPE: ranks, splits and the automaton of compatible pairs
    def _splits(self) -> None:
        """rank: when a piece is made by a merge (characters: -1). split: the two pieces that are merged last."""
        m = self.model
        order = sorted((i for i in self.id.values() if len(m.pieces[i]) > 1), key=lambda i: (-m.scores[i], i))
        self.rank = [-1] * len(m.pieces)
        for r, i in enumerate(order):
            self.rank[i] = r
        self.split: dict[int, tuple[int, int]] = {}
        self.dead: set[int] = set()
        for i in order:
            parts = self._merge(m.pieces[i], self.rank[i])
            if len(parts) == 2 and all(p in self.id for p in parts):
                self.split[i] = (self.id[parts[0]], self.id[parts[1]])
            else:  # its own encoding is another path: no text is ever encoded to it
                self.dead.add(i)

    def _merge(self, text: str, below: int) -> list[str]:
        """Merge text's characters with the pieces of rank under below, best first, leftmost on ties."""
        s = list(text)
        while len(s) > 1:
            best, at = below, -1
            for k in range(len(s) - 1):
                i = self.id.get(s[k] + s[k + 1])
                if i is not None and self.rank[i] < best:
                    best, at = self.rank[i], k
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def compatible(self, a: int, b: int) -> bool:
        """May piece b follow piece a? Undo merges at the seam, latest first; no merge across it may have come earlier."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is not None:
            return known
        pieces, rank, ids = self.model.pieces, self.rank, self.id
        limit, x, y, ok = 1 << 60, a, b, True
        while True:
            over = ids.get(pieces[x] + pieces[y])
            if over is not None and rank[over] < limit:
                ok = False
                break
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                limit, x = rx, self.split[x][1]
            else:  # of two equal merges the left one comes first, so the right one is undone first
                limit, y = ry + 1, self.split[y][0]
        if len(self.pairs) > 4_000_000:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    # --- composition and shortest path
    def _fallback(self, c: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in c.encode("utf-8", "surrogatepass")) if len(self.bytes) == 256 else (self.model.unk,)

    def path(self, s: str) -> tuple[int, ...]:
        """Ids on the shortest path of the lattice of s, a part of an escaped text."""
        return self._path_bpe(s) if self.model.bpe else self._path_unigram(s)

    def _path_bpe(self, s: str) -> tuple[int, ...]:
        n = len(s)
        last = [-1] + [-2] * n  # the piece that ends here on the only path; -2: a fallback character
        back = list(range(-1, n))
        pairs = self.pairs
        for end, (t, size) in self.lattice.iter(s):  # arcs by their end, longest first
            p = end + 1
            if last[p] == -2:
                prev = last[p - size]
                if prev < 0:
                    last[p], back[p] = t, p - size
                else:
                    ok = pairs.get(prev << 20 | t)
                    if ok or ok is None and self.compatible(prev, t):
                        last[p], back[p] = t, p - size
        out: list[int] = []
        p = n
        while p:
            t = last[p]
            if t == -2:
                out += self._fallback(s[p - 1])[::-1]
            else:
                out.append(t)
            p = back[p]
        out.reverse()
        return tuple(out)

    def _path_unigram(self, s: str) -> tuple[int, ...]:
        scores, n = self.model.scores, len(s)
        worst = min(scores) - 10.0
        best, back, arc = [0.0] + [float("inf")] * n, [0] * (n + 1), [-2] * (n + 1)
        arcs: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, (t, size) in self.lattice.iter(s):
            arcs[end + 1].append((t, end + 1 - size))
        for p in range(1, n + 1):
            for t, q in arcs[p]:
                if best[q] - scores[t] < best[p]:
                    best[p], back[p], arc[p] = best[q] - scores[t], q, t
            if best[p - 1] - worst < best[p]:
                best[p], back[p], arc[p] = best[p - 1] - worst, p - 1, -2
        out: list[int] = []
        p = n
        while p:
            out += self._fallback(s[p - 1])[::-1] if arc[p] == -2 else [arc[p]]
            p = back[p]
        return tuple(reversed(out))

    def normalize(self, text: str) -> str:
        if self.model.strip:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (ESC if self.model.dummy_prefix else "") + text.replace(" ", ESC)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memory.__getitem__, self.unit.findall(self.normalize(text)))))

    def decode(self, ids: list[int]) -> str:
        """Inverse transducer: pieces back to text, bytes joined, escapes undone, the dummy prefix dropped."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.spelt.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(self.spelt[i])
            text = "".join(out) + run.decode("utf-8", "replace")
        text = text.replace(ESC, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


class _Parts(dict):
    """Escaped part of an input -> its encoding, within a bound."""

    LIMIT, LONG = 800_000, 48

    def __init__(self, path) -> None:
        super().__init__()
        self.path = path

    def __missing__(self, part: str) -> tuple[int, ...]:
        got = self.path(part)
        if len(part) <= self.LONG:
            if len(self) >= self.LIMIT:
                self.clear()
            self[part] = got
        return got


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    if path not in _compiled:
        with open(path, "rb") as f:
            _compiled[path] = Transducer(Model(f.read()))
    return _compiled[path]


def _encode(path: str, with_ids: bool):
    def run(batches):
        t = compiled(path)
        gc.disable()  # what is remembered are many small objects without cycles
        try:
            for batch in batches:
                for part, texts in slices(batch):
                    ids, n, crc, same = [], [], [], []
                    for text in texts:
                        got = t.encode(text or "")
                        n.append(len(got))
                        crc.append(zlib.crc32(np.array(got, dtype="<u4").tobytes()))
                        same.append(t.decode(got) == (text or "").replace(ESC, " "))
                        ids.append(got if with_ids else None)
                    cols = [part.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                    names = ["id", "n_pieces", "ids_crc32", "round_trip"]
                    if with_ids:
                        cols.append(pa.array(ids, pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names=names)
        finally:
            gc.enable()

    return run


def encode_documents(docs: DataFrame, model: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_pieces, ids_crc32 of the ids as little-endian unsigned 32-bit integers, round_trip[, ids]).

    model: path of the model file, readable on every executor. round_trip: decoding gives the text back (a text's own
    escape characters come back as spaces). Null texts count as empty: no pieces.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    out = src.mapInArrow(_encode(model, with_ids), f"id {src.schema['id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of (id, ids); null ids give a null text."""

    def run(batches):
        t = compiled(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    src = encoded.select(F.col(id_col).alias("id"), F.col("ids").cast("array<int>"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


