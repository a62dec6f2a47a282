"""Token-id files with bit-plane shuffling.

Documents are encoded, an end id is appended to each, and the ids are cut into fixed-size blocks in ascending order of
document id. A block is transposed into bit planes (plane b holds bit b of every id) or byte planes, each plane is
compressed with zstandard, and the planes are concatenated behind a header. A file is a sequence of such chunks; its
chunk index says for every chunk which ids it holds and where it starts. Files are rows (part, chunk, n_ids, payload) in
Parquet, so any store that Spark writes to can hold them; the documents' lengths are a column file of their own.

Parts are ranges of document ids. Encoding writes each part on its own; a part's first id position is the sum of the
parts before it, a table with one row per part.
"""

from __future__ import annotations

import gc
import struct
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, shuffles_removed, slices

MAGIC = b"BPL1"
BLOCK = 65536
#: Bytes of text of a part file, about.
PART = 32 << 20


def _turn8(x: np.ndarray) -> np.ndarray:
    """Transpose 8 x 8 bit matrices held in 64-bit words (row i is byte i); its own inverse."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        s = np.uint64(shift)
        t = (x ^ (x >> s)) & np.uint64(mask)
        x = x ^ t ^ (t << s)
    return x


def pack(ids: np.ndarray, planes: str = "bit", level: int = 1) -> bytes:
    """One chunk: magic, plane kind, number of ids, number of planes, planes' compressed sizes, planes."""
    n, wide = len(ids), -(-len(ids) // 8) * 8
    padded = np.zeros(wide, dtype="<u4")
    padded[:n] = ids
    top = int(padded.max()).bit_length() if n else 0
    raw = padded.view(np.uint8).reshape(-1, 4)
    rows: list[bytes] = []
    for k in range(-(-top // 8)):
        column = np.ascontiguousarray(raw[:, k])
        if planes == "bit":
            turned = _turn8(column.view("<u8")).view(np.uint8).reshape(-1, 8)
            rows += [np.ascontiguousarray(turned[:, b]).tobytes() for b in range(min(8, top - 8 * k))]
        else:
            rows.append(column[:n].tobytes())
    z = zstandard.ZstdCompressor(level=level)
    done = [z.compress(r) for r in rows]
    return MAGIC + struct.pack("<BII", planes == "bit", n, len(rows)) + struct.pack(f"<{len(rows)}I", *map(len, done)) + b"".join(done)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a chunk, as little-endian unsigned 32-bit integers."""
    if payload[:4] != MAGIC:
        raise ValueError("not a chunk of a token-id file")
    bit, n, used = struct.unpack_from("<BII", payload, 4)
    sizes = struct.unpack_from(f"<{used}I", payload, 13)
    at, z, rows = 13 + 4 * used, zstandard.ZstdDecompressor(), []
    for s in sizes:
        rows.append(np.frombuffer(z.decompress(payload[at : at + s]), dtype=np.uint8))
        at += s
    wide = -(-n // 8) * 8
    raw = np.zeros((wide, 4), dtype=np.uint8)
    if bit:
        for k in range(-(-used // 8)):
            turned = np.zeros((wide // 8, 8), dtype=np.uint8)
            for b, r in enumerate(rows[8 * k : 8 * k + 8]):
                turned[:, b] = r
            raw[:, k] = _turn8(turned.view("<u8").reshape(-1)).view(np.uint8)
    else:
        for k, r in enumerate(rows):
            raw[:n, k] = r
    return raw.reshape(-1).view("<u4")[:n]


class WordEncoder(dict):
    """Whole texts to ids by a public tokenizers file; a bounded dict of what white-space-free pieces encode to.

    The tokenizer drops white space and never joins across it, so a text's ids are its pieces' ids in order. Pieces are
    cut at spaces and newlines only; what else counts as white space is left to the library. Ids are held as
    little-endian 32-bit integers.
    """

    LIMIT = 1_000_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)

    def __missing__(self, piece: str) -> bytes:
        got = array("I", self.tok.encode_batch_fast([piece], add_special_tokens=False)[0].ids).tobytes()
        if len(piece) <= 48:
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@dataclass(frozen=True)
class TokenFiles:
    """Where a set of token-id files lies: chunks (part, chunk, first_id, n_ids, payload) and lengths (part, doc ids and sizes by chunk)."""

    path: str

    def chunks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(CHUNK).parquet(self.path)

    def index(self, spark: SparkSession) -> DataFrame:
        """The chunk index: where each chunk starts inside its part; payloads are not read."""
        return self.chunks(spark).drop("payload", "docs", "sizes")

    def parts(self, spark: SparkSession) -> DataFrame:
        """(part, part_ids, start): ids of each part and of all parts before it; one row per part file."""
        from pyspark.sql import Window

        per = self.index(spark).groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
        w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        return per.select("part", "part_ids", F.coalesce(F.sum("part_ids").over(w), F.lit(0)).alias("start"))


CHUNK = "part int, chunk int, first_id long, n_ids long, docs binary, sizes binary, payload binary"


def _writer(path: str, end_id: int, planes: str):
    def run(batches):
        from pyspark import TaskContext

        enc, part = word_encoder(path), TaskContext.get().partitionId()
        end, held, docs, sizes = array("I", [end_id]).tobytes(), bytearray(), [], []
        chunk, first = 0, 0

        def emit(ids, d, s):
            nonlocal chunk, first
            row = (part, chunk, first, len(ids), np.array(d, dtype="<i8").tobytes(), np.array(s, dtype="<i8").tobytes(), pack(ids, planes))
            chunk, first = chunk + 1, first + len(ids)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["part", "chunk", "first_id", "n_ids", "docs", "sizes", "payload"])

        gc.disable()  # what is remembered are many small objects without cycles
        try:
            for doc, text in (x for batch in batches for part, texts in slices(batch) for x in zip(part.column(0).to_pylist(), texts, strict=True)):
                got = enc.encode(text or "")
                held += got
                held += end
                docs.append(doc)
                sizes.append(len(got) // 4 + 1)
                if len(held) >= 4 * BLOCK:
                    ids, k = np.frombuffer(bytes(held), dtype="<u4"), 0
                    while len(ids) - k >= BLOCK:
                        yield emit(ids[k : k + BLOCK], docs, sizes)
                        docs, sizes, k = [], [], k + BLOCK
                    held = bytearray(ids[k:].tobytes())
            if held or docs:
                yield emit(np.frombuffer(bytes(held), dtype="<u4"), docs, sizes)
        finally:
            gc.enable()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, planes: str = "bit", path: str | None = None, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode docs (null text: empty; null id: not written) and write their ids in ascending order of id.

    Ids are integers. parts: ranges of ids, by default one for every PART bytes of text. tokenizer: path of a tokenizers file. planes: "bit" or "byte". Rows that repeat an id all stay, in order of text.
    """
    spark = docs.sparkSession
    path = path or scratch(spark)
    src = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if parts is None:
        parts = max(1, -(-(src.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART))
    ranged = src.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    with shuffles_removed(spark):  # the texts dealt out are not kept beside the files made of them
        ranged.mapInArrow(_writer(tokenizer, end_id, planes), CHUNK).write.parquet(path)
    return TokenFiles(path)


def _reader(batches):
    """Chunks of a part in order -> one row per document; a document may span chunks. State: what is known of open documents."""
    rows, open_docs, crc, missing, at, part, base = [], [], 0, 0, 0, None, 0

    def flush(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    for b in batches:
        for p, start, d, s, payload in zip(*(b.column(k).to_pylist() for k in ("part", "start", "docs", "sizes", "payload")), strict=True):
            if p != part:
                part, at, open_docs, missing, base = p, 0, [], 0, start
            open_docs += zip(np.frombuffer(d, "<i8").tolist(), np.frombuffer(s, "<i8").tolist(), strict=True)
            ids, k, done = unpack(payload), 0, 0
            raw = memoryview(ids.tobytes())
            for doc, size in open_docs:
                take = min(size - missing, len(ids) - k)
                crc = zlib.crc32(raw[4 * k : 4 * (k + take)], crc if missing else 0)
                missing, k = missing + take, k + take
                if missing < size:
                    break
                rows.append((doc, base + at, size, crc))
                at, missing, done = at + size, 0, done + 1
            open_docs = open_docs[done:]
        yield flush(rows)
        rows = []


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Per document, read back from the files: (doc_id, start, n_tokens, ids_crc32)."""
    chunks = files.chunks(spark).join(files.parts(spark).select("part", "start"), "part")
    return chunks.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
