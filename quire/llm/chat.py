"""Chat formatting with typed content parts.

A turn is a list of parts (text, image, audio, document). A visitor walks the parts and flattens them into the template:
text is escaped, every attachment becomes an ordered placeholder, and the visitor records the attachment's reference and
the number of tokens the placeholder stands for once it is expanded. Turns stream through in conversation order, one
segment per turn, so a conversation may be longer than memory; ``read_back`` parses segments the same way.

Template: ``<|turn|>role\\n`` text ``<|end|>\\n``. Inside texts a backslash is doubled, and control strings (ours and those
of common templates) get a backslash after their first character, so no control string survives in a text and the
escape is undone exactly.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Beginnings of control strings that texts must not contain.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_UNESCAPE = re.compile(r"\\\\|\\n|" + "|".join(re.escape(c[0]) + r"\\" + re.escape(c[1:]) for c in CONTROLS))
PARTS = "array<struct<type:string,text:string,ref:string,size:long>>"
SEGMENT = "conv_id long, turn long, role string, segment string, loss_start long, loss_end long, attachments array<struct<kind:string,ref:string,offset:long,tokens:long>>, expanded_tokens long"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[0] == "\\\\" else "\n" if m[0] == "\\n" else m[0][0] + m[0][2:], text)


def escape_line(text: str) -> str:
    """escape() of a text that must stay on one line."""
    return escape(text).replace("\n", "\\n")


class Flattener:
    """Visitor of content parts: builds the flattened text, the attachment records and the expanded token count.

    token_sizes: bytes (or pixels, or samples) of an attachment that one token stands for, by kind; at least one token.
    """

    def __init__(self, token_sizes: dict[str, int] | None = None) -> None:
        self.sizes = {"image": 1024, "audio": 640, "document": 4096} | (token_sizes or {})
        self.out: list[str] = []
        self.at, self.tokens = 0, 0
        self.attachments: list[dict] = []

    def _put(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_attachment)(part)

    def visit_text(self, part: dict) -> None:
        self._put(escape(part.get("text") or ""))

    def visit_attachment(self, part: dict) -> None:
        kind = re.sub(r"[^a-z]", "", (part.get("type") or "").lower()) or "other"
        n = max(1, -(-(part.get("size") or 0) // self.sizes.get(kind, 4096)))
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "offset": self.at, "tokens": n})
        self.tokens += n
        self._put(f"<|{kind}:{len(self.attachments)}|>")

    visit_image = visit_audio = visit_document = visit_attachment


def _segments(token_sizes, loss_roles):
    def run(batches):
        for batch in batches:
            rows = {k: [] for k in ("conv_id", "turn", "role", "segment", "loss_start", "loss_end", "attachments", "expanded_tokens")}
            for r in batch.to_pylist():
                role = r["role"] or ""
                head = f"{TURN}{escape_line(role)}\n"
                f = Flattener(token_sizes)
                for part in r["parts"] or []:
                    f.visit(part)
                body = "".join(f.out)
                masked = role in loss_roles
                for k, v in zip(rows, (r["conv_id"], r["turn"], role, head + body + END, len(head) if masked else None, len(head) + len(body) if masked else None, [a | {"offset": a["offset"] + len(head)} for a in f.attachments], f.tokens), strict=True):
                    rows[k].append(v)
            t = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int64()), ("tokens", pa.int64())])
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(t), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, x) for v, x in zip(rows.values(), types, strict=True)], names=list(rows))

    return run


def format_chat(turns: DataFrame, token_sizes: dict[str, int] | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format conversations given as (conv_id long, turn long, role string, parts array<struct<type,text,ref,size>>).

    Returns one segment per turn, co-located and sorted by conversation, turn, role and text; a conversation's formatted
    text is its segments joined. loss_start and loss_end (code points inside the segment) delimit the text under the loss
    mask, null where there is none. Null roles and parts count as empty; a null turn comes first; equal rows all stay.
    """
    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("first").asc_nulls_first()]
    src = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("parts").cast(PARTS), F.to_json("parts").alias("first"))
    return src.repartition("conv_id").sortWithinPartitions(*key).drop("first").mapInArrow(_segments(token_sizes, loss_roles), SEGMENT)


def text_parts(text) -> F.Column:
    """A text column as a single typed part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), null.cast("string").alias("ref"), null.cast("long").alias("size"))).cast(PARTS)


_HEAD = re.compile(re.escape(TURN) + r"([^\n]*)\n")


def _digest(batches):
    """Parse formatted segments as they stream by and keep running digests; one row when a conversation ends."""

    def fresh(c):
        return {"conv": c, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_n": 0, "chars": 0}

    def row(s):
        return (s["conv"], s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"])

    state, out = None, []

    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for b in batches:
        for c, seg, start, end in zip(*(b.column(k).to_pylist() for k in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
            if state is None or state["conv"] != c:
                if state is not None:
                    out.append(row(state))
                state = fresh(c)
            m = _HEAD.match(seg)
            if not m or not seg.endswith(END):
                raise ValueError("a segment does not follow the template")
            role, text = unescape(m[1]), unescape(seg[m.end() : -len(END)])
            state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state["n"] += 1
            state["chars"] += len(seg)
            if start is not None:
                masked = unescape(seg[start:end])
                state["loss"].update(masked.encode("utf-8", "surrogatepass"))
                state["loss_n"] += len(masked)
        yield batch(out)
        out = []
    if state is not None:
        out.append(row(state))
    yield batch(out)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests read back from format_chat's output (which is already co-located and sorted): one row per conversation.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    """
    return segments.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
