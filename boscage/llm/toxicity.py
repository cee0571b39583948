"""Toxicity by compression distance.

A text is written in codes of ``CODE`` bytes, two for each of its words: hashes of the
word's first ``STEM`` characters and of the whole word, in lower case (of writing without blanks, of
every two characters). So a word costs as much wherever it stands, and what a
dictionary saves is whole words, not the syllables that all texts share.

Two zstandard dictionaries of one capacity are trained from labelled rows in this
writing: one on windows of ordinary text, one on windows of toxic text, of which
only the words stay that are far more frequent in toxic rows. The ordinary dictionary's
content stands behind the toxic one, so that both know ordinary language
equally well. A window that compresses better with the toxic dictionary
speaks for toxicity.

A document is judged by its runs of 1 to 64 windows, never by its mean: a run's
gain is compared with the runs of that length in ordinary rows that the
training did not see. The score is the negative decimal logarithm of how often
ordinary text of the document's length has a run like its best one. A document
is toxic beyond both ``FALSE_POSITIVES`` on that scale and all but this share
of the held-out ordinary rows. Of n rows this is order statistic
max(1, FALSE_POSITIVES * (n + 1)) from the top, so a new ordinary row passes it
with a probability of max(FALSE_POSITIVES, 1 / (n + 1)) at most; the rule is
the same for any n.

Defined cases: a null text or one without a word of ``LEAST_CHARS`` characters has no
windows, score 0 and is not toxic; a text of any length is windowed whole; equal texts get equal
scores; repeated rows stay repeated; of several texts or labels of one labelled id
the greatest counts; with no toxic or no ordinary labelled row
there is no model and nothing is toxic; only the id, text and label columns
are looked at, so further columns may have any name.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, id_text, keep_rows, pick, slices, table, tidy

#: Bytes of a word's code, characters of a stem, and of a word at least.
CODE, STEM, LEAST_CHARS = 8, 5, 3
#: Bytes of a window, which is 64 codes; as codes are never cut, windows don't overlap.
WINDOW, OVERLAP = 64 * CODE, 0
#: Labelled rows to fit on, of each class: toxic, ordinary.
TRAIN_ROWS = (1500, 3000)
#: Share of ordinary held-out documents that may pass the threshold.
FALSE_POSITIVES = 0.01
#: Bytes of each dictionary, at most.
CAPACITY = 1 << 19
#: Windows of the runs that are judged.
RUNS = (1, 2, 4, 8, 16, 32, 64)
#: Share of ordinary runs that the tail of each length is fitted to.
TAIL = 0.02
#: Toxic rows that a word must be in; a number, so that no language or topic is too rare among many rows.
LEAST_ROWS = 3
#: Times the share of ordinary rows that the share of toxic rows with a word is, at least.
RATIO = 4
#: Codes that a worker remembers.
REMEMBERED = 100_000
_WORD = re.compile(rf"[^\W_]{{{LEAST_CHARS},}}")
SCHEMA = "doc_id long, windows int, score double, toxic boolean"


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: float
    #: For each of RUNS: a gain, the share of ordinary runs beyond it, and by how much they are beyond it on average.
    tails: tuple[tuple[float, float, float], ...]
    threshold: float


class _Codes(dict):
    """Codes of words, remembered up to a number of them."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if word[0] >= "\u2e80":  # writing without blanks
            found = b"".join(xxhash.xxh3_64_digest(word[i : i + 2].encode("utf-8", "surrogatepass")) for i in range(len(word) - 1))
        else:
            found = b"".join(xxhash.xxh3_64_digest(w.encode("utf-8", "surrogatepass")) for w in dict.fromkeys((word[:STEM], word)))
        self[word] = found
        return found


_codes = _Codes()


def coded(text: bytes | str) -> bytes:
    """The codes of all words of a text, given as it is or in UTF-8."""
    text = text if isinstance(text, str) else text.decode("utf-8", "replace")
    return b"".join(map(_codes.__getitem__, _WORD.findall(text.lower())))


def windows(data: bytes) -> list[bytes]:
    """All of a coded text in windows of whole words."""
    return [data[i : i + WINDOW] for i in range(0, len(data), WINDOW - OVERLAP)]


def words(data: bytes) -> list[bytes]:
    return [data[i : i + CODE] for i in range(0, len(data), CODE)]


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(
        window_log=20, hash_log=19, chain_log=20, search_log=4, min_match=6, target_length=32, strategy=zstd.STRATEGY_GREEDY,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS,
    )
    known = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=known, compression_params=params)


class Scorer:
    """Compressors for one task; they can't be sent between processes."""

    def __init__(self, model: Model):
        self.model = model
        self.ordinary, self.toxic = _compressor(model.ordinary).compress, _compressor(model.toxic + model.ordinary).compress

    def gains(self, text: bytes | str) -> list[int]:
        return [len(self.ordinary(w)) - len(self.toxic(w)) for w in windows(coded(text))]

    def runs(self, gains: list[int]) -> list[np.ndarray]:
        """Gain over the ordinary mean of all runs, for each of RUNS that the text is long enough for."""
        upto = np.concatenate([[0.0], np.cumsum(np.array(gains, float) - self.model.mean)])
        return [upto[r:] - upto[:-r] for r in RUNS if r <= len(gains)]

    def score(self, gains: list[int]) -> float:
        if not gains:
            return 0.0
        found = []
        for r, run, (level, share, scale) in zip(RUNS, self.runs(gains), self.model.tails):
            found.append((run.max() - level) / scale - np.log(share) - np.log(len(gains) / r))
        return float(max(found) / np.log(10))


def toxic_words(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Words that are in far more of the toxic texts than of the ordinary ones."""
    n1, n0 = len(toxic), len(ordinary)
    there = Counter(w for t in toxic for w in set(words(t)))
    elsewhere = Counter(w for t in ordinary for w in set(words(t)))
    out = set()
    for w, c in there.items():
        p1, p0, p = c / n1, elsewhere[w] / n0, (c + elsewhere[w]) / (n1 + n0)
        error = (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5
        if c >= LEAST_ROWS and p1 >= RATIO * (elsewhere[w] + 1) / (n0 + 1) and p1 - p0 >= 5 * error:
            out.add(w)
    return out


def _trained(samples: list[bytes]) -> bytes:
    try:
        return zstd.train_dictionary(CAPACITY, samples, level=3).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(dict.fromkeys(samples))[-CAPACITY:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The ordinary one, trained on windows without toxic words; the toxic one, trained on the toxic words of toxic windows; words that the trainer left out stand before its content."""
    bad = toxic_words(toxic, ordinary)
    plain = _trained([w for t in ordinary for w in windows(b"".join(x for x in words(t) if x not in bad))])
    if not bad:
        return plain, b""
    content = _trained([b"".join(found) for t in toxic for w in windows(t) if (found := [x for x in words(w) if x in bad])])
    return plain, b"".join(sorted(w for w in bad if w not in content))[-CAPACITY:] + content


def fit(toxic: list[bytes | str], ordinary: list[bytes | str]) -> Model | None:
    """Train on the toxic and every second ordinary text, and calibrate on the other ordinary texts, which nothing in the training sees."""
    toxic, ordinary = ([t for t in dict.fromkeys(x) if coded(t)] for x in (toxic, ordinary))
    if not toxic or not ordinary:
        return None
    seen, held = ordinary[::2], ordinary[1::2] or ordinary
    model = Model(*dictionaries([*map(coded, toxic)], [*map(coded, seen)]), 0.0, (), 0.0)
    scorer = Scorer(model)
    gains = [scorer.gains(t) for t in held]
    scorer.model = model = replace(model, mean=float(np.mean([x for g in gains for x in g])))
    of_length: list[list[np.ndarray]] = [[] for _ in RUNS]
    for g in gains:
        for found, run in zip(of_length, scorer.runs(g)):
            found.append(run)
    tails: list[tuple[float, float, float]] = []
    for found in of_length:
        if not found or len(run := np.concatenate(found)) < 1 / TAIL:
            # too few runs of this length: they vary as independent ones of the length before do
            level, share, scale = tails[-1] if tails else (0.0, 1.0, 1.0)
            tails.append((level * 2**0.5, share, scale * 2**0.5))
            continue
        level = float(np.quantile(run, 1 - TAIL))
        beyond = run[run > level]
        share, scale = max(len(beyond), 1) / len(run), max(0.5, float((beyond - level).mean()) if len(beyond) else 0.0)
        # a run holds shorter ones, so its tail is no lighter than theirs, however few texts are that long
        tails.append((max(level, tails[-1][0]), share, max(scale, tails[-1][2])) if tails else (level, share, scale))
    scorer.model = model = replace(model, tails=tuple(tails))
    scores = sorted((scorer.score(g) for g in gains), reverse=True)
    rank = max(1, int(FALSE_POSITIVES * (len(scores) + 1)))
    return replace(model, threshold=max(-float(np.log10(FALSE_POSITIVES)), scores[rank - 1]))


def train(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = TRAIN_ROWS) -> Model | None:
    """Fit on at most ``rows`` labelled documents of each class, chosen by a hash of the id."""
    said = pick(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).cache()
    picked = functools.reduce(DataFrame.unionByName, [said.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, rows[0]), (0, rows[1]))])
    found = id_text(docs).join(F.broadcast(picked), "doc_id").where("text is not null").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    said.unpersist()
    found.sort(key=lambda r: r["doc_id"])
    return fit(*([r["text"] for r in found if r["toxic"] == k] for k in (1, 0)))


def _verdicts(model: Model | None, text: pa.Array, scorer: Scorer | None) -> tuple[list[int], list[float], list[bool]]:
    gains = [scorer.gains(t) if scorer and t else [] for t in text.to_pylist()]
    count = [len(g) for g in gains] if scorer else [len(windows(coded(t))) if t else 0 for t in text.to_pylist()]
    scores = [scorer.score(g) if scorer else 0.0 for g in gains]
    return count, scores, [bool(model) and x > model.threshold for x in scores]


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each document: its windows, its score and whether it is toxic."""

    def run(batches):
        scorer = Scorer(model) if model else None
        schema = pa.schema([("doc_id", pa.int64()), ("windows", pa.int32()), ("score", pa.float64()), ("toxic", pa.bool_())])
        for batch in batches:
            for part in slices(batch):
                yield as_batch([part.column("doc_id"), *_verdicts(model, part.column("text"), scorer)], schema)
        _codes.clear()
        tidy()

    return id_text(docs).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, all columns as they are; rows move nowhere."""

    def decider():
        _codes.clear()
        scorer = Scorer(model) if model else None
        return lambda text: [not x for x in _verdicts(model, text, scorer)[2]]

    return keep_rows(docs, decider)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(docs, train(docs, table(spark, sf_dir, "labels")))
