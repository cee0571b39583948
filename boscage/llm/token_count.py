"""Token counts by byte-pair merging on a heap and a linked list, without ids.

Each word (piece of the vocabulary's pattern) starts as a linked list of
bytes. A heap holds the adjacent pairs that can merge, lowest rank first; the
lowest is popped, stale entries are passed over, and the two new neighbours
are pushed. The count is the number of bytes less the number of merges.
Counts of words are remembered within a worker process.

Defined cases: a null text has a null count, an empty one 0; texts are counted
whole; repeated rows stay repeated; equal texts get equal counts; the count of
text without a place to split takes time n log n; further columns may have any
name.
"""

from __future__ import annotations

import base64
import functools
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PATTERN, default_vocabulary
from .common import as_batch, id_text, slices, table

#: Words whose count a worker process remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 400_000, 24


@functools.lru_cache(maxsize=2)
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


class Counter:
    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def merges(self, word: bytes) -> int:
        """How many merges the word takes."""
        n, ranks = len(word), self.ranks
        if word in ranks:
            return n - 1
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        end = list(range(1, n + 1))  # where the symbol that starts here ends; 0 once it is merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapify(heap)
        merged = 0
        while heap:
            _, i, to = heappop(heap)
            j = right[i]
            if not end[i] or j >= n or end[j] != to:
                continue
            merged += 1
            end[i], end[j] = to, 0
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                if (r := ranks.get(word[i : end[after]])) is not None:
                    heappush(heap, (r, i, end[after]))
            before = left[i]
            if before >= 0 and (r := ranks.get(word[before:to])) is not None:
                heappush(heap, (r, before, to))
        return merged

    def count(self, text: str) -> int:
        known, total = self.known, 0
        for p in self.pieces(text):
            n = known.get(p)
            if n is None:
                b = p.encode()
                n = len(b) - self.merges(b)
                if len(p) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        for old in list(known)[: REMEMBERED // 2]:
                            del known[old]
                    known[p] = n
            total += n
        return total

    def counts(self, text: pa.Array) -> np.ndarray:
        """Counts of all texts; the words between single blanks are counted once each.

        A blank after something that isn't blank begins a piece in any case, so
        a text is the sum of its words, each with the blank before it. Texts
        with other blanks at a word's edge are counted as they are.
        """
        words = pc.split_pattern(pc.fill_null(text, ""), " ")
        offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
        flat = words.flatten()
        coded = flat.dictionary_encode()
        unique = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy()
        edge = np.array([not w or w[-1].isspace() for w in unique], bool)[at] if len(at) else np.zeros(0, bool)
        first = np.zeros(len(at) + 1, bool)
        first[offsets[:-1]] = True
        first = first[: len(at)]
        own = np.array([self.count(w) for w in set_of(unique, at[first])], np.int64) if len(at) else np.zeros(0, np.int64)
        lead = np.zeros(len(unique), np.int64)
        lead[np.unique(at[first])] = own
        later = np.zeros(len(unique), np.int64)
        rest = np.unique(at[~first])
        later[rest] = [self.count(" " + unique[i]) for i in rest.tolist()]
        each = np.where(first, lead[at], later[at])
        upto = np.concatenate([[0], np.cumsum(each)])
        total = upto[offsets[1:]] - upto[offsets[:-1]]
        last = np.zeros(len(at), bool)
        last[offsets[1:] - 1] = True
        odd = np.concatenate([[0], np.cumsum(edge & ~last)])
        for k in np.flatnonzero(odd[offsets[1:]] > odd[offsets[:-1]]).tolist():
            total[k] = self.count(text[k].as_py())
        return total


def set_of(unique: list[str], at: np.ndarray) -> list[str]:
    return [unique[i] for i in np.unique(at).tolist()]


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row for each document with the number of its tokens."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        c = counter(vocabulary)
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                yield as_batch([part.column("doc_id"), pa.array(c.counts(text), mask=text.is_null().to_numpy(zero_copy_only=False))], schema)

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
