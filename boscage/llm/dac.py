"""Token-id output in directly addressable codes.

The ids of a document are cut into 8-bit chunks, lowest first. Level 0 holds
the first chunk of every id; an id that needs more has its bit set in the
level's continuation bitmap, and its next chunk lies in the next level at the
rank of that bit. A directory of ranks at every 512 bits makes ``rank`` one
lookup and a count of at most 64 bytes, so any token is read by itself,
without decoding a block.

Layout of a payload, little endian: b"DAC1", uint32 number of ids, uint8
number of levels; then for each level uint32 n, n chunk bytes, and, but for
the last level, ceil(n/8) bitmap bytes and a uint32 rank for every 512 bits.

Defined cases: a null text has a null payload, an empty one a payload of no
levels; ids may be any of 0 to 2**32 - 1; texts are written whole; repeated
rows stay repeated; further columns may have any name.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec, default_vocabulary
from .common import id_text, slices, table

BLOCK = 512
SCHEMA = "doc_id long, n_tokens int, n_bytes int, payload binary"
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint32)


def pack(ids: np.ndarray) -> bytes:
    """The payload of one sequence of ids."""
    rest = np.asarray(ids, np.uint32)
    out, levels = [], 0
    while len(rest):
        more = rest > 255
        out += [struct.pack("<I", len(rest)), rest.astype(np.uint8).tobytes()]
        levels += 1
        # an id of the last level has no bits left, so only the levels before have a bitmap
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        upto = np.concatenate([[0], np.cumsum(_ONES[bits], dtype=np.uint32)])
        out += [bits.tobytes(), upto[:-1][:: BLOCK // 8].astype("<u4").tobytes()]
        rest = rest[more] >> np.uint32(8)
    return b"".join([b"DAC1", struct.pack("<IB", len(ids), levels), *out])


class Reader:
    """Random access to a payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a DAC payload")
        self.data = payload
        self.n, levels = struct.unpack_from("<IB", payload, 4)
        self.levels, at = [], 9
        for k in range(levels):
            (n,) = struct.unpack_from("<I", payload, at)
            bitmap = at + 4 + n
            ranks = bitmap + (n + 7) // 8
            self.levels.append((at + 4, bitmap if k + 1 < levels else None, ranks))
            at = ranks + 4 * (((n + 7) // 8 + BLOCK // 8 - 1) // (BLOCK // 8))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= self.data[chunks + i] << shift
            shift += 8
            if bitmap is None or not self.data[bitmap + i // 8] >> i % 8 & 1:
                break
            block = i // BLOCK
            (rank,) = struct.unpack_from("<I", self.data, ranks + 4 * block)
            full = self.data[bitmap + block * (BLOCK // 8) : bitmap + i // 8]
            i = rank + int.from_bytes(full, "little").bit_count() + (self.data[bitmap + i // 8] & ((1 << i % 8) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every id at once."""
        out = np.zeros(self.n, np.uint32)
        where = np.arange(self.n)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[where] |= np.frombuffer(self.data, np.uint8, len(where), chunks).astype(np.uint32) << np.uint32(8 * k)
            if bitmap is not None:
                where = where[np.unpackbits(np.frombuffer(self.data, np.uint8, (len(where) + 7) // 8, bitmap), count=len(where), bitorder="little").astype(bool)]
        return out


def write_ids(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row for each document with its token ids as a payload."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        c = codec(vocabulary)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("n_bytes", pa.int32()), ("payload", pa.binary())])
        for batch in batches:
            for part in slices(batch):
                ids = [None if t is None else c.encode(t) for t in part.column("text").to_pylist()]
                packed = [None if e is None else pack(np.array(e, np.uint32)) for e in ids]
                columns = [part.column("doc_id"), [None if e is None else len(e) for e in ids], [None if p is None else len(p) for p in packed], packed]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, list) else x for x, f in zip(columns, schema)], schema=schema)

    return id_text(docs).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_ids(table(spark, sf_dir, "documents"))
