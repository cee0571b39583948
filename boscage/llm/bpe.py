"""Byte-pair encoding and decoding with tree concatenation.

A text is split into pieces by the vocabulary's pattern. A long piece (no
place to split in it) is halved again and again; the parts are encoded apart
and joined: tokens around a join are encoded anew in a window that grows
until its first token is the left part's and its last is the right part's.
As every neighbouring pair of tokens is then one that encoding gives, the
joined sequence is exactly the encoding of the whole.

A long document is itself cut into halves that are encoded by different
tasks. A join of two text parts splits anew from the last blank after
something that isn't blank in the left to the first such blank in the right,
as no piece ever goes across these; a piece that continues the left's last
piece by the right's first is joined as above.

Defined cases: a null text has null tokens and null counts, an empty one an
empty array; special-token strings in a text are ordinary text; texts are
encoded whole at any length; repeated rows stay repeated; equal texts get
equal tokens; decoding null gives null, and ids outside the vocabulary are an
error; further columns may have any name.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, slices, table, tidy

#: Bytes from which a piece without a split is encoded in halves.
LONG_PIECE = 256
#: Characters of a text that one task encodes; longer ones are cut into halves.
LONG_TEXT = 1 << 16
SCHEMA = "doc_id long, n_tokens int, token_ids array<int>, round_trip boolean"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    """Where the installed public vocabulary lies; on a cluster, pass a path that executors can read."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / "byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return Codec(vocabulary)


class Codec:
    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("boscage", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.plain = self.encoding.encode_ordinary
        self.raw = self.encoding._encode_single_piece
        self.pattern = regex.compile(PATTERN)
        self.unsplit = regex.compile(rf"\S{{{LONG_PIECE // 4},}}|\s{{{LONG_PIECE // 4},}}")
        self.edge, self.edge_back = regex.compile(r"\S\s"), regex.compile(r"(?r)\S\s")
        self.bytes_of = self.encoding.decode_bytes

    def encode(self, text: str) -> list[int]:
        """Token ids of a text."""
        if not self.unsplit.search(text):
            return self.plain(text)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            piece = m[0].encode()
            out += self.raw(piece) if len(piece) <= LONG_PIECE else self.tree(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")

    def tree(self, piece: bytes) -> list[int]:
        """Encode one piece by halves."""
        if len(piece) <= LONG_PIECE:
            return self.raw(piece)
        level = [self.raw(piece[i : i + LONG_PIECE // 2]) for i in range(0, len(piece), LONG_PIECE // 2)]
        while len(level) > 1:
            level = [self.join_tokens(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of a piece, of the encodings of its two parts."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            middle = self.raw(self.bytes_of(a + b))
            if (k >= len(left) or middle[0] == a[0]) and (k >= len(right) or middle[-1] == b[-1]):
                return left[:-k] + middle + right[k:]
            k *= 2

    def join_texts(self, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
        """Text and encoding of two parts of a text, each given with its encoding."""
        (lt, li), (rt, ri) = left, right
        if not lt or not rt:
            return lt + rt, li + ri
        at, to = self._last_edge(lt), self._first_edge(rt)
        before, after = lt[at:], rt[:to]
        kept, tail = self._cut(li, len(before.encode()), from_end=True)
        head, rest = self._cut(ri, len(after.encode()), from_end=False)
        tokens: list[int] = []
        for m in self.pattern.finditer(before + after):
            x, y = before[m.start() :], after[: max(0, m.end() - len(before))]
            if x and y and self.pattern.findall(before)[-1] == x and self.pattern.match(after)[0] == y:
                tokens += self.join_tokens(self._cut(tail, len(x.encode()), from_end=True)[1], self._cut(head, len(y.encode()), from_end=False)[0])
            else:
                tokens += self._piece(m[0])
        return lt + rt, kept + tokens + rest

    def _piece(self, text: str) -> list[int]:
        return self.tree(text.encode())

    def _last_edge(self, text: str) -> int:
        """Where the last blank after something that isn't blank is: no piece ever goes across it."""
        m = self.edge_back.search(text)
        return m.start() + 1 if m else 0

    def _first_edge(self, text: str) -> int:
        m = self.edge.search(text)
        return m.start() + 1 if m else len(text)

    def _cut(self, ids: list[int], size: int, from_end: bool) -> tuple[list[int], list[int]]:
        """Two parts of ``ids``, the last or the first of which has ``size`` bytes."""
        n = got = 0
        token = self.encoding.decode_single_token_bytes
        while got < size:
            n += 1
            got += len(token(ids[-n] if from_end else ids[n - 1]))
        at = len(ids) - n if from_end else n
        return ids[:at], ids[at:]


def _rows(doc_ids: list, encoded: list[list[int] | None], same: list[bool | None], schema: pa.Schema) -> pa.RecordBatch:
    counts = [None if e is None else len(e) for e in encoded]
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([c or 0 for c in counts], out=offsets[1:])
    flat = np.fromiter((t for e in encoded if e for t in e), np.int32, int(offsets[-1]))
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([c is None for c in counts]))
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int32()), ids, pa.array(same, pa.bool_())], schema=schema)


def encode(docs: DataFrame, vocabulary: str | None = None, long_text: int = LONG_TEXT) -> DataFrame:
    """One row for each document: its tokens, and whether decoding them gives the text back."""
    vocabulary = vocabulary or default_vocabulary()
    docs = id_text(docs)
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int32()), ("token_ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])

    def whole(batches):
        c = codec(vocabulary)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                texts = part.column("text").to_pylist()
                encoded = [None if t is None else c.encode(t) for t in texts]
                same = [None if t is None else c.bytes_of(e) == t.encode() for t, e in zip(texts, encoded)]
                yield _rows(part.column("doc_id").to_pylist(), encoded, same, out_schema)
        tidy()

    def leaves(batches):
        c = codec(vocabulary)
        schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("nth", pa.int32()), ("text", pa.string()), ("token_ids", pa.list_(pa.int32()))])
        for batch in batches:
            for part in slices(batch):
                encoded = [c.encode(t) for t in part.column("text").to_pylist()]
                tokens = _rows([0] * len(encoded), encoded, [None] * len(encoded), out_schema).column("token_ids")
                yield pa.RecordBatch.from_arrays([part.column(n).cast(schema.field(n).type) for n in schema.names[:4]] + [tokens], schema=schema)

    def joined(group: pa.Table) -> pa.Table:
        c = codec(vocabulary)
        group = group.sort_by("nth")
        level = list(zip(group.column("text").to_pylist(), group.column("token_ids").to_pylist()))
        while len(level) > 1:
            level = [c.join_texts(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        text, ids = level[0]
        return pa.Table.from_batches([_rows([group.column("doc_id")[0].as_py()], [ids], [c.decode(ids) == text], out_schema)])

    size = F.length("text")
    short = docs.where(size.isNull() | (size <= long_text)).mapInArrow(whole, SCHEMA)
    halves = F.pow(F.lit(2), F.ceil(F.log2(size / long_text))).cast("int")
    step = F.ceil(size / F.col("parts")).cast("int")
    cut = docs.where(size > long_text).withColumn("key", F.monotonically_increasing_id()).withColumn("parts", halves).withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select("key", "doc_id", "nth", F.substring(F.col("text"), F.col("nth") * step + 1, step).alias("text"))
    long = cut.repartition("key", "nth").mapInArrow(leaves, "key long, doc_id long, nth int, text string, token_ids array<int>").groupBy("key").applyInArrow(joined, SCHEMA)
    return short.unionByName(long)


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The text of each row's ``token_ids``."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        c = codec(vocabulary)
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        for batch in batches:
            texts = [None if t is None else c.decode(t) for t in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], schema=schema)

    return tokens.select(F.col("doc_id").cast("long"), "token_ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs)
