"""Language identification with bit-sliced Bloom filters of byte n-grams.

All languages share one table of slots; a slot holds one bit for each
language, 64 of them in a plane. An n-gram is looked up at ``HASHES`` slots, and the AND of what they
hold is the set of languages that (but for false positives) contain it. The
bits are counted for each language over a whole text, and the counts are
corrected by the filter's known false-positive rate; the largest share of a
text's n-grams decides.

Only n-grams of letters and spaces count, of the text in lower case. Defined
cases: a null, empty or letterless text is ``und`` and rejected; a text with
fewer than ``LEAST_GRAMS`` n-grams is too short to reject: it gets the best
language, or ``und``, and stays; texts whose best share is under ``LEAST_SHARE``
are ``und`` and rejected; ties go to the first language in the alphabet; a text
of any length is read whole; repeated rows stay repeated; with nothing to train
on, every text is ``und`` and those with letters stay; further columns may
have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_batch, id_text, keep_rows, pick, slices, table, tidy, utf8_buffer

GRAM, HASHES = 4, 3
#: Labelled documents to train on, of each language.
TRAIN_ROWS = 400
LEAST_GRAMS, LEAST_SHARE = 24, 0.3
SLOT_BITS = 20
SCHEMA = "doc_id long, detected string, share double, grams long, keep boolean"
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_LETTER = np.array([chr(b).isalpha() or b >= 0x80 for b in range(128)] + [True] * 128)
_PLAIN = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: A row for each plane of up to 64 languages.
    slots: np.ndarray
    false_positive: np.ndarray


def _gram_values(data: np.ndarray) -> np.ndarray:
    """The n-gram that starts at each byte, as a number; the last few bytes have none."""
    d = data.astype(np.uint32)
    return d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24) if len(d) >= GRAM else np.zeros(0, np.uint32)


def _at(grams: np.ndarray) -> list[np.ndarray]:
    return [((grams ^ grams >> np.uint32(15)) * np.uint32(f)) >> np.uint32(32 - SLOT_BITS) for f in _FACTORS]


def prepare(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with one blank before and after each text and in place of all but letters; offsets."""
    data, offsets = utf8_buffer(pc.utf8_lower(pc.fill_null(text, "")))
    lengths = np.diff(offsets)
    out = np.full(len(data) + len(lengths) * 2, 32, np.uint8)
    starts = offsets[:-1] + 2 * np.arange(len(lengths)) + 1
    out[np.arange(len(data)) + np.repeat(starts - offsets[:-1], lengths)] = _PLAIN[data]
    return out, np.concatenate([starts - 1, [len(out)]])


def _real(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which n-grams lie in one text and hold no two blanks in a row."""
    n = max(0, len(data) - GRAM + 1)
    blank = data == 32
    double = np.zeros(len(data) + 1, np.int32)
    np.cumsum(blank[:-1] & blank[1:], out=double[2:]) if len(data) > 1 else None
    ok = double[GRAM : GRAM + n] == double[1 : 1 + n]
    for k in range(1, GRAM):
        at = offsets[1:] - k
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def fit(texts: dict[str, list[str]]) -> Model:
    """Filters of the n-grams that occur at least twice in a language's texts."""
    names = tuple(sorted(texts))
    slots = np.zeros((-(-len(names) // 64) or 1, 1 << SLOT_BITS), np.uint8 if len(names) <= 8 else np.uint64)
    for k, name in enumerate(names):
        data, offsets = prepare(pa.array(texts[name], pa.string()))
        grams, count = np.unique(_gram_values(data)[_real(data, offsets)], return_counts=True)
        for at in _at(grams[count > 1]):
            slots[k // 64, at] |= slots.dtype.type(1 << k % 64)
    fill = [np.count_nonzero(slots[k // 64] & slots.dtype.type(1 << k % 64)) / (1 << SLOT_BITS) for k in range(len(names))]
    return Model(names, slots, np.array(fill) ** HASHES)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` documents of each declared language, chosen by a hash of the id."""
    docs = pick(docs, doc_id="long", lang="string", text="string")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = docs.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang").withColumn("nth", rank).where(F.col("nth") <= rows).select("doc_id").distinct()
    texts: dict[str, list[str]] = {}
    for r in docs.select("doc_id", "lang", "text").join(F.broadcast(picked), "doc_id").where("lang is not null and text is not null").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return fit(texts)


def shares(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: corrected share of every language, number of n-grams, whether it has letters."""
    data, offsets = prepare(text)
    n, ok = len(offsets) - 1, _real(data, offsets)
    edges = offsets[:-1]
    grams = np.zeros(len(data), np.int64)
    grams[: len(ok)] = ok
    total = np.add.reduceat(grams, edges) if n else np.zeros(0, np.int64)
    letters = np.add.reduceat((data != 32).astype(np.int64), edges) > 0 if n else np.zeros(0, bool)
    out = np.zeros((n, len(model.languages)))
    values = _gram_values(data)
    places = _at(values)
    for k in range(len(model.languages)):
        if k % 64 == 0:
            a, b, c = (model.slots[k // 64, at] for at in places)
            mask = a & b & c
            mask[~ok] = 0
        grams[:] = 0
        grams[: len(ok)] = (mask >> model.slots.dtype.type(k % 64)) & model.slots.dtype.type(1)
        hits = np.add.reduceat(grams, edges) if n else grams
        rate = model.false_positive[k]
        out[:, k] = np.maximum(0, (hits - total * rate) / (1 - rate)) / np.maximum(total, 1)
    return out, total, letters


def decide(model: Model, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    share, total, letters = shares(model, text)
    if not model.languages:
        return ["und"] * len(text), np.zeros(len(text)), total, letters
    best = share.argmax(axis=1)
    top = share[np.arange(len(best)), best]
    short = total < LEAST_GRAMS
    known = (top >= LEAST_SHARE) | short & (top > 0)
    return [model.languages[k] if y else "und" for k, y in zip(best, known)], top, total, letters & (known | short)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each document: language, share of its n-grams, number of n-grams, whether to keep it."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("detected", pa.string()), ("share", pa.float64()), ("grams", pa.int64()), ("keep", pa.bool_())])
        for batch in batches:
            for part in slices(batch):
                yield as_batch([part.column("doc_id"), *decide(model, part.column("text"))], schema)
        tidy()

    return id_text(docs).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` in a known language, all columns as they are; rows move nowhere."""

    return keep_rows(docs, lambda: lambda text: decide(model, text)[3])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs, train(docs))
