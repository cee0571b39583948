"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test strings are the ``WORDS``-word windows of every benchmark item (the whole
item where it has fewer words), compared after folding ASCII case and turning
each run of ASCII characters other than letters and digits into one blank. The
search looks at one block of the text at a time: a block that no test string
has lets it skip ahead by nearly the length of the shortest one, any other
block skips to where it would fit, and a block that ends a test string's head
is hashed to the bucket of strings to compare directly.

Defined cases: null and empty texts and items match nothing; an item without a
letter or digit has no test string; matches begin and end at word boundaries;
equal items are each reported, rows of one item_id are one item; texts are searched whole; repeated documents
are reported once each; null doc_ids are reported as null; an empty table of either
kind gives no rows; further columns may have any name.

The distinct test strings travel by broadcast in parts of ``PASS_BYTES``, a documented bound of
what a worker holds, and each part is searched in all documents. With one part, as
usual, the documents are read once; with more, what the parts find in a
document is added up, so the number of parts never changes the result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, as_batch, checkpoint, id_text, keep_rows, pick, slices, stored, table, tidy, utf8_buffer

WORDS = 13
#: Test strings shorter than this are searched apart, so that they don't shorten the others' skips.
SHORT = 32
#: Bytes of test strings that one pass over the documents looks for.
PASS_BYTES = 32 << 20
SCHEMA = "doc_id long, item_id long, hits int, first_at int"


def fold(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Each text folded, with one blank before and after it."""
    out = FOLD[data]
    stay = np.ones(len(out), bool)
    stay[1:] = (out[1:] != 32) | (out[:-1] != 32)
    ends = np.concatenate([[0], np.cumsum(stay)])[offsets]
    out = out[stay].tobytes()
    return [b" " + out[a:b].strip(b" ") + b" " for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


class Matcher:
    """Shift table and suffix buckets for one set of strings."""

    def __init__(self, patterns: dict[bytes, set[int]]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = block = max(1, min(12, m // 3))
        self.skip = m - block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[int, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(block, m + 1):
                part = p[end - block : end]
                self.shift[part] = min(self.shift.get(part, self.skip), m - end)
            self.bucket[hash(p[m - block : m])].append(p)

    def search(self, text: bytes):
        """Yield the start and the items of every occurrence."""
        m, block, far, shift, bucket = self.m, self.block, self.skip, self.shift.get, self.bucket
        end, n = m, len(text)
        while end <= n:
            part = text[end - block : end]
            step = shift(part, far)
            if step:
                end += step
                continue
            for p in bucket[hash(part)]:
                if text.startswith(p, end - m):
                    yield end - m, self.patterns[p]
            end += 1


def test_strings(items: list[tuple[int, str | None]], words: int = WORDS) -> dict[bytes, set[int]]:
    out: dict[bytes, set[int]] = defaultdict(set)
    for item, text in items:
        w = fold(*utf8_buffer(pa.array([text], pa.string())))[0].split()
        for k in range(max(1, len(w) - words + 1)) if w else ():
            out[b" " + b" ".join(w[k : k + words]) + b" "].add(item)
    return dict(out)


def matchers(patterns: dict[bytes, set[int]]) -> list[Matcher]:
    short = {p: i for p, i in patterns.items() if len(p) < SHORT}
    return [Matcher(part) for part in (short, {p: i for p, i in patterns.items() if p not in short}) if part]


class _Passes:
    """The distinct test strings in parts, each a broadcast of (string, items)."""

    def __init__(self, benchmark: DataFrame):
        def run(batches):
            schema = pa.schema([("item_id", pa.int64()), ("string", pa.binary())])
            for batch in batches:
                rows = [(i, s) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()) for s in test_strings([(i, t)])]
                if rows:
                    yield as_batch(list(zip(*rows)), schema)

        items = pick(benchmark, item_id="long", text="string").where("item_id is not null and text is not null")
        found = items.mapInArrow(run, "item_id long, string binary").groupBy("string").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        found = checkpoint(found)
        size = found.agg(F.sum(F.length("string"))).first()[0] or 0
        self.spark, self.parts = benchmark.sparkSession, -(-size // PASS_BYTES)
        self.found = found.withColumn("part", F.pmod(F.xxhash64("string"), F.lit(max(1, self.parts))))

    def __iter__(self):
        for k in range(self.parts):
            rows = self.found.where(F.col("part") == k).select("string", "items").collect()
            yield self.spark.sparkContext.broadcast({bytes(r["string"]): set(r["items"]) for r in rows})


_kept: list = [None, []]


def _matchers(patterns) -> list[Matcher]:
    """The matchers of a broadcast, made once in a worker and kept for the tasks that follow."""
    if _kept[0] is not patterns.value:
        _kept[:] = patterns.value, matchers(patterns.value)
    return _kept[1]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item whose test strings it has: how many occurrences, and where the first is in the folded text."""
    passes = _Passes(benchmark)
    docs = id_text(docs).withColumn("row", F.monotonically_increasing_id() if passes.parts > 1 else F.lit(0).cast("long"))
    if passes.parts > 1:
        docs = stored(docs, "documents-to-search")

    def searcher(patterns):
        def run(batches):
            machines = _matchers(patterns)
            schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("hits", pa.int32()), ("first_at", pa.int32())])
            for batch in batches:
                rows = []
                for part in slices(batch):
                    for row, doc, text in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), fold(*utf8_buffer(part.column("text")))):
                        found: dict[int, list[int]] = {}
                        for machine in machines:
                            for at, items in machine.search(text):
                                for item in items:
                                    hit = found.setdefault(item, [0, at])
                                    hit[0] += 1
                                    hit[1] = min(hit[1], at)
                        rows += [(row, doc, item, n, at) for item, (n, at) in found.items()]
                if rows:
                    yield as_batch(list(zip(*rows)), schema)
            tidy()

        return run

    out = docs.sparkSession.createDataFrame([], "row long, " + SCHEMA)
    for k, patterns in enumerate(passes):
        part = docs.mapInArrow(searcher(patterns), "row long, " + SCHEMA)
        out = out.unionByName(part) if k else part
    if passes.parts > 1:
        out = out.groupBy("row", "doc_id", "item_id").agg(F.sum("hits").cast("int").alias("hits"), F.min("first_at").alias("first_at"))
    return out.drop("row")


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any test string, all columns as they are; rows move nowhere."""

    def cleaner(patterns):
        def decider():
            machines = _matchers(patterns)
            return lambda text: [not any(True for machine in machines for _ in machine.search(t)) for t in fold(*utf8_buffer(text))]

        return decider

    for patterns in _Passes(benchmark):
        docs = keep_rows(docs, cleaner(patterns))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs, table(spark, sf_dir, "benchmark"))


def _folded(column: str) -> str:
    return f"trim(regexp_replace(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' ')"


SQL = f"""
WITH item AS (SELECT item_id, string_split({_folded('text')}, ' ') AS w FROM benchmark WHERE {_folded('text')} <> ''),
win AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[k:k + {WORDS - 1}], ' ') || ' ' AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) AS k FROM item)),
doc AS (SELECT doc_id, ' ' || {_folded('text')} || ' ' AS t FROM documents),
hit AS (SELECT doc_id, item_id, s, t FROM doc JOIN win ON contains(t, s))
SELECT doc_id, item_id,
       CAST(sum(len([p for p in range(1, len(t) + 1) if starts_with(t[p:], s)])) AS INTEGER) AS hits,
       CAST(min(octet_length(encode(t[1:instr(t, s) - 1]))) AS INTEGER) AS first_at
FROM hit GROUP BY doc_id, item_id
"""
