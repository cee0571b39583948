"""Exact Jaccard join of documents over word n-grams, by grouped prefixes.

A document is the set of its runs of ``WORDS`` words (ASCII case folded, every
run of ASCII characters other than letters and digits a blank; a text of fewer
words is one run). Two sets with a Jaccard index of at least ``THRESHOLD`` share an
n-gram among the first ``size - ceil(threshold * size) + 1`` of each, in any
order that is the same for all sets. The order here puts the n-grams that
occur in many documents last, so few sets meet that aren't alike.

1. Count the documents of every n-gram; the most frequent make the order. The
   order decides how fast the join is, never what it returns.
2. Documents with the same prefix and size are one group, which is indexed
   once, under each n-gram of its prefix. A sample of ``SAMPLED`` rows shows the leaders
   of large clusters of near copies; what holds half of a leader's sketch is one group for
   each class of sizes, indexed under the n-grams of all its prefixes. So the thousands of a
   cluster don't meet one another under each n-gram. Leaders, too, decide only how fast
   the join is. Groups that meet there are near enough in
   size or passed over, and their meetings are counted: sets of which the first
   has its last prefix n-gram earlier share only what their prefixes share and
   what lies behind that one's prefix, so alike ones meet often. Groups
   that meet often enough for their sizes are candidate pairs.
3. Candidate groups of up to ``CROWD`` sets expand to these, and every pair of sets is
   verified: first by bitmaps, each n-gram of a set flipping one bit of two or
   more for each n-gram, as sets differ in no fewer n-grams than their bitmaps in
   bits; then on the whole sets. Pairs of sets of one group, or of a larger group
   and its partners, are never rows: they meet in tiles of ``BLOCK`` by ``BLOCK``, in each of
   which one task compares all whole sets at once.

``classes`` gives one row for each document: its class (the smallest doc_id of the
documents that are alike to it over any number of steps), how many other documents have an
equal set (``copies``), and to how many different sets its own is alike
(``links``). Tasks count the links of what they compare and join it to forests, so
pairs aren't rows there either. ``similar`` gives the pairs, in bicliques: each document of
``left_ids`` has with each other document of ``right_ids`` the given index. Documents with
equal sets are one row, with themselves on both sides and an index of 1, and take part as one
in the others. So thousands of copies don't make millions of rows.

n-grams and sets are told apart by 64-bit hashes. Defined cases: a
null or empty text, or one without a letter or digit, is alike to nothing and a class
of its own; rows with a null doc_id can't be named, so they are in no class and always kept; rows
of one doc_id are one document: its class has what any of its texts is alike to, its
links and copies are those of its different sets together, and ``keep_one`` keeps all of
its rows or none, but one only of those that are equal in text; sets of equal size tie by their
smallest doc_id; an empty table gives no rows; texts are taken whole; further
columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FOLD, as_batch, checkpoint, id_text, join_side, slices, stored, table, tidy, utf8_buffer, without

WORDS, THRESHOLD = 3, 0.6
#: An n-gram in more documents than this goes behind all others in the order, and to its end, by number of documents, if it is among the most frequent ``ORDERED``.
FREQUENT, ORDERED = 10, 1 << 19
#: log2 of the bits that tell frequent n-grams, in each part and in all at most. Others that share their bit go behind, too.
MARKED, MARKED_ALL = 16, 28
#: Bits of an n-gram, beside those that name its part, by which it is counted for the order.
COUNTED = 24
#: n-grams that a worker gathers before it sends them on, and pairs that it counts together.
GATHERED, COUNTED_PAIRS = 1 << 20, 1 << 19
#: Bytes of text whose n-grams a worker makes at once, and for each part of the n-gram index.
GRAM_BYTES, PART_BYTES = 1 << 19, 2 << 20
#: Groups of a long list that meet in one task, and candidate pairs that are compared in one, about.
LIST, PLACE_PAIRS = 1024, 20_000
#: Meetings by which two groups may fall short, as n-grams of one set with equal shortened hashes (about 2**-40) meet once.
SLACK = 3
#: Sets of one cluster of candidates that are verified together, on each side.
BLOCK = 256
#: Sets of a group up to which candidate pairs with it are rows.
CROWD = 32
#: Rows, about, in which leaders are looked for; distinct sets there that one must be with those around it, most leaders, and n-grams of a sketch.
SAMPLED, AROUND, LEADERS, SKETCH = 8192, 6, 256, 64
SCHEMA = "doc_id long, class_id long, copies long, links long"

_K = 0x9E3779B97F4A7C15
_INVERSE = pow(_K, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1), modulo 2**64; remembered but for very long texts."""
    kept = max(n, GRAM_BYTES + (1 << 16))
    found = _powers.get(base)
    if found is None or len(found) < n:
        steps = np.full(kept, base, np.uint64)
        steps[0] = 1
        found = np.multiply.accumulate(steps)
        if kept == GRAM_BYTES + (1 << 16):
            _powers[base] = found
    return found[:n]


def gram_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text as ascending hashes, end to end, and offsets."""
    data, offsets = utf8_buffer(text)
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = FOLD[data]
    blank = out == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    upto = np.zeros(len(out) + 1, np.uint64)
    np.cumsum(_BYTE[out] * _power(_K, len(out)), out=upto[1:])
    words = np.concatenate([_mix((upto[ends] - upto[starts]) * _power(_INVERSE, len(out))[starts]), np.zeros(WORDS, np.uint64)])
    first = np.searchsorted(starts, offsets[:-1] + np.arange(n))  # each text's first word
    counts = np.diff(np.concatenate([first, [len(starts)]]))
    left = np.repeat(first + counts, counts) - np.arange(len(starts))  # words from here to the end of the text
    grams = np.zeros(len(starts), np.uint64)
    for k in range(WORDS):
        grams += np.where(left > k, words[k : k + len(starts)] * _PLACE[k], np.uint64(k))
    stay = left >= np.minimum(WORDS, np.repeat(counts, counts))
    grams = _mix(grams[stay])
    edges = np.concatenate([[0], np.cumsum(np.where(counts, np.maximum(1, counts - WORDS + 1), 0))])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        grams[a:b].sort()
    fresh = np.ones(len(grams), bool)
    fresh[1:] = grams[1:] != grams[:-1]
    fresh[edges[:-1][edges[:-1] < len(grams)]] = True
    return grams[fresh], np.concatenate([[0], np.cumsum(fresh)])[edges]


class Order:
    """The order of n-grams: rare ones by hash, then frequent ones by hash, as ``marks`` tell them, then the most frequent by number of documents."""

    def __init__(self, bits: int, keys: np.ndarray, documents: np.ndarray, marks: np.ndarray):
        self.bits, self.marks = bits, marks
        by_key = np.argsort(keys)
        self.keys = keys[by_key].astype(np.uint64)
        rank = np.empty(len(keys), np.uint32)
        rank[np.lexsort((keys, documents))] = np.arange(2, len(keys) + 2)
        self.rank = rank[by_key]

    def ranks(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(grams), np.uint32)
        short = grams >> np.uint64(64 - COUNTED - self.bits)
        at = np.minimum(np.searchsorted(self.keys, short), len(self.keys) - 1)
        place = grams >> np.uint64(64 - self.bits - _marked(self.bits))
        behind = self.marks[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)
        return np.where(self.keys[at] == short, self.rank[at], behind.astype(np.uint32))


def _marked(bits: int) -> int:
    """log2 of the marks of a part, of 2**bits."""
    return min(MARKED, MARKED_ALL - bits)


class Leaders:
    """Sketches (the least n-grams) of sets in the midst of many alike ones. Any leaders give the same result."""

    def __init__(self, sketches: list[np.ndarray], sizes: list[int]):
        self.lengths, self.sizes = np.array([len(x) for x in sketches], np.int64), np.array(sizes, np.int64)
        flat = np.concatenate([*sketches, np.zeros(0, np.uint64)])
        by = np.argsort(flat, kind="stable")
        self.leader = np.repeat(np.arange(len(sketches)), self.lengths)[by]
        self.grams, self.first, self.times = np.unique(flat[by], return_index=True, return_counts=True)

    def of(self, grams: np.ndarray, edges: np.ndarray) -> list[int]:
        """For each set the leader of whose sketch it holds the largest share, of a half or more, of those half to twice as large; else -1."""
        n = len(edges) - 1
        if not len(self.grams):
            return [-1] * n
        low = np.flatnonzero(grams <= self.grams[-1])
        at = np.searchsorted(self.grams, grams[low])
        found = self.grams[at] == grams[low]
        at, row = at[found], np.searchsorted(edges, low[found], side="right") - 1
        times = self.times[at]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pairs, held = np.unique(np.repeat(row, times) * len(self.lengths) + self.leader[np.repeat(self.first[at], times) + nth], return_counts=True)
        row, leader = pairs // len(self.lengths), pairs % len(self.lengths)
        share = np.where(_comparable(np.diff(edges)[row], self.sizes[leader]), held / self.lengths[leader], 0)
        row, leader = (x[np.argsort(share, kind="stable")][np.sort(share) >= 0.5] for x in (row, leader))
        out = np.full(n, -1)
        out[row] = leader  # of one row's, the last stays, which has the largest share
        return out.tolist()


def _comparable(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (n <= 2 * m) & (m <= 2 * n)


def _leaders_among(sketches: list[np.ndarray], sizes: np.ndarray) -> Leaders:
    """Sets that are at least ``AROUND`` with those around them, by their sketches; those with the most common n-grams first."""
    flat, lengths = np.concatenate([*sketches, np.zeros(0, np.uint64)]), np.array([len(x) for x in sketches], np.int64)
    row = np.repeat(np.arange(len(sketches)), lengths)
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.bincount(row[times[inverse] >= AROUND], minlength=len(sketches))
    free, found = np.ones(len(sketches), bool), []
    for k in np.argsort(-common, kind="stable").tolist():
        if len(found) == LEADERS or 2 * common[k] < lengths[k]:
            break
        if free[k]:
            near = (2 * np.bincount(row[np.isin(flat, sketches[k])], minlength=len(sketches)) >= lengths[k]) & _comparable(sizes, sizes[k])
            if np.count_nonzero(near & free) >= AROUND:
                found.append(k)
                free &= ~near
        free[k] = False
    return Leaders([sketches[k] for k in found], [int(sizes[k]) for k in found])


def leaders(docs: DataFrame, n: int) -> Leaders:
    """Look for leaders in a sample of ``docs``, which has ``n`` rows."""

    def sketch(batches):
        schema = pa.schema([("digest", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary())])
        for batch in batches:
            for part in slices(batch, limit=GRAM_BYTES):
                grams, edges = gram_sets(part.column("text"))
                sets = [grams[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if a < b]
                yield as_batch([[_digest(x) for x in sets], [len(x) for x in sets], [x[:SKETCH].tobytes() for x in sets]], schema)
        tidy()

    some = docs.select("text")
    rows = (some if n <= SAMPLED else some.sample(SAMPLED / n, 7)).mapInArrow(sketch, "digest long, size long, sketch binary").toArrow()
    by = {d: (x, n) for d, n, x in zip(*(c.to_pylist() for c in rows.columns))}
    return _leaders_among([np.frombuffer(by[d][0], np.uint64) for d in sorted(by)], np.array([by[d][1] for d in sorted(by)], np.int64))


def prefix_size(size: int, threshold: float) -> int:
    return size - math.ceil(threshold * size - 1e-9) + 1


#: Sizes are known in classes of this ratio where whole sets aren't at hand.
_RATIO = 1.06


def _size_class(size: int) -> int:
    return min(255, int(math.log(size) / math.log(_RATIO)))


def _least_meetings(pairs: np.ndarray, threshold: float) -> np.ndarray:
    """How often two groups of these size classes meet at least, if sets of theirs are alike."""
    low = _RATIO ** (pairs & np.uint64(0xFF)).astype(float) * (1 - 1e-9)
    high = np.where(pairs & np.uint64(0xFF) == 255, np.inf, low * _RATIO * (1 + 1e-8))
    return np.minimum(60_000, threshold / (1 + threshold) * low.sum(axis=1) - threshold * high.max(axis=1) - SLACK)


def _described(text: pa.Array, order: Order, led: Leaders, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, bool] | None]:
    """For each text: size, set, prefix, group, and if that is a leader's; None without a set."""
    grams, edges = gram_sets(text)
    ranks = order.ranks(grams)
    some = np.concatenate([[0], np.cumsum(ranks > 0)])[edges]
    for a, b, hot, leader in zip(edges[:-1].tolist(), edges[1:].tolist(), (some[1:] > some[:-1]).tolist(), led.of(grams, edges)):
        if a == b:
            yield None
            continue
        whole = grams[a:b]
        p = prefix_size(b - a, threshold)
        prefix = whole[np.argsort(ranks[a:b], kind="stable")[:p]] if hot else whole[:p]
        group = xxhash.xxh3_64_intdigest(prefix.tobytes() + (b - a).to_bytes(8, "little") if leader < 0 else b"leader %d" % leader)
        yield b - a, whole, prefix, group & ~0xFF | _size_class(b - a), leader >= 0


def _bits(size: int) -> int:
    """log2 of the number of parts of the n-gram index, which follows the bytes of text."""
    return min(24, max(4, math.ceil(math.log2(max(1, size / PART_BYTES)))))


def _parts(grams: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Where each part of the ascending ``grams`` lies."""
    edges = np.searchsorted(grams >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return ((k, slice(a, b)) for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if a < b)


def _short(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(32 - bits)).astype(np.uint32)


def _tight(numbers: np.ndarray) -> bytes:
    """Numbers of ``COUNTED`` bits as bytes."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : COUNTED // 8].tobytes()


def _loose(column: pa.ChunkedArray) -> np.ndarray:
    raw = _joined(column, np.uint8).reshape(-1, COUNTED // 8)
    out = np.zeros((len(raw), 4), np.uint8)
    out[:, : COUNTED // 8] = raw
    return out.view("<u4").ravel()


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def frequent(docs: DataFrame, bits: int) -> Order:
    """Count the documents of every n-gram, and keep the most frequent for the order."""

    def count(batches):
        schema = pa.schema([("part", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])
        held, n = [], 0

        def send():
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            rows = []
            for k, s in _parts(grams, bits):
                short, c = (grams[s] >> np.uint64(64 - COUNTED - bits)) & np.uint64((1 << COUNTED) - 1), counts[s]
                rows.append((k, _tight(short[c == 1]), _tight(short[c > 1]), c[c > 1].astype(np.uint32).tobytes()))
            return as_batch(list(zip(*rows)), schema)

        for batch in batches:
            for part in slices(batch, limit=GRAM_BYTES):
                held.append(gram_sets(part.column("text"))[0])
                n += len(held[-1])
                if n > GATHERED:
                    yield send()
                    held, n = [], 0
        if n:
            yield send()
            held.clear()
        tidy()

    def total(key: tuple, group: pa.Table) -> pa.Table:
        once, more = _loose(group.column("once")), _loose(group.column("more"))
        counts = np.concatenate([np.ones(len(once), np.uint32), _joined(group.column("counts"), np.uint32)])
        grams = np.concatenate([once, more])
        by = np.argsort(grams, kind="stable")
        grams, starts = np.unique(grams[by], return_index=True)
        documents = np.add.reduceat(counts[by].astype(np.int64), starts) if len(starts) else starts
        hot = documents > FREQUENT
        marks = np.zeros(1 << _marked(bits), bool)
        marks[grams[hot] >> (COUNTED - _marked(bits))] = True
        keys, documents = (np.uint64(key[0].as_py()) << np.uint64(COUNTED)) | grams[hot].astype(np.uint64), documents[hot]
        most = np.argsort(-documents, kind="stable")[:ORDERED]
        none = pa.nulls(len(most), pa.binary())
        return pa.concat_tables([
            pa.table({"gram": pa.array([key[0].as_py()], pa.int64()), "documents": pa.array([-1], pa.int64()), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())}),
            pa.table({"gram": pa.array(keys[most].astype(np.int64)), "documents": pa.array(documents[most], pa.int64()), "marks": none}),
        ])

    counted = docs.select("text").mapInArrow(count, "part int, once binary, more binary, counts binary").groupBy("part").applyInArrow(total, "gram long, documents long, marks binary")
    counted = stored(counted, "ngram-counts")
    marks = np.zeros(1 << (bits + _marked(bits) - 3), np.uint8)
    parts = marks.reshape(1 << bits, -1)
    found = counted.where("marks IS NOT NULL").select("gram", "marks").toArrow()
    for k, part in zip(found.column("gram").to_pylist(), found.column("marks")):
        parts[k] = np.frombuffer(part.as_buffer(), np.uint8)
    top = counted.where("marks IS NULL").select("gram", "documents").orderBy(F.desc("documents"), "gram").limit(ORDERED).toArrow()
    return Order(bits, top.column("gram").to_numpy().astype(np.uint64), top.column("documents").to_numpy(), marks)


def bitmap(grams: np.ndarray) -> bytes:
    """Of a set: each n-gram flips the bit that its hash names."""
    bits = 1 << max(6, (2 * len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, the larger folded to the size of the smaller."""
    a, b = (np.frombuffer(z, np.uint64) for z in (x, y))
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _digest(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


def described(docs: DataFrame, order: Order, led: Leaders, threshold: float) -> DataFrame:
    """(doc_id, grp, digest, size, bitmap) for each row; nulls and size 0 for one without a set. Written, as it is read several times."""

    def describe(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("grp", pa.int64()), ("digest", pa.int64()), ("size", pa.int32()), ("bitmap", pa.binary())])
        for batch in batches:
            for part in slices(batch, limit=GRAM_BYTES):
                found = _described(part.column("text"), order, led, threshold)
                rows = [(i, np.uint64(g[3]).astype(np.int64), _digest(g[1]), g[0], bitmap(g[1])) if g else (i, None, None, 0, None) for i, g in zip(part.column("doc_id").to_pylist(), found)]
                yield as_batch(list(zip(*rows)), schema)
        tidy()

    return stored(docs.mapInArrow(describe, "doc_id long, grp long, digest long, size int, bitmap binary"), "ngram-sets")


def members_of(rows: DataFrame) -> DataFrame:
    """(doc_id, grp, digest, size): every document with each of its sets, once."""
    return rows.where("size > 0").select("doc_id", "grp", "digest", "size").distinct()


def sets_of(members: DataFrame) -> DataFrame:
    """One row for each distinct set: its first document, and how many have it. Counts are added up before they are shuffled."""
    return members.groupBy("grp", "digest", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("documents"))


def _meetings(groups: np.ndarray, starts: np.ndarray, reach: int) -> Iterator[np.ndarray]:
    """Pairs of groups from each run of ``groups`` (sorted within runs) that are near enough in size."""
    lengths = np.diff(np.concatenate([starts, [len(groups)]]))
    cls = (groups & np.uint64(0xFF)).astype(np.int16)
    for n in np.unique(lengths[lengths > 1]).tolist():
        runs = starts[lengths == n]
        step = max(1, (1 << 18) // (n * n))
        for at in range(0, len(runs), step):
            rows = runs[at : at + step, None]
            for lo in range(0, n - 1, 512):  # a long list in blocks of rows
                i, j = np.triu_indices(min(512, n - lo), 1, n - lo)
                a, b = (rows + lo + i).ravel(), (rows + lo + j).ravel()
                near = np.abs(cls[a] - cls[b]) <= reach
                yield np.stack([groups[a[near]], groups[b[near]]], axis=1)


def _added_up(pairs: list[np.ndarray], times: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, and the sum of how many times each came."""
    flat = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.uint64)
    each = np.concatenate(times).astype(np.int64) if times else np.ones(len(flat), np.int64)
    by = np.lexsort((flat[:, 1], flat[:, 0]))
    flat, each = flat[by], each[by]
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]).any(axis=1)
    starts = np.flatnonzero(fresh)
    return flat[starts], np.add.reduceat(each, starts) if len(starts) else each


def _blocks(members: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A long list in pairs of blocks, of which the second is empty where a block meets itself; blocks too far apart in size don't meet."""
    members = members[np.argsort(members & np.uint64(0xFF), kind="stable")]
    cls = (members & np.uint64(0xFF)).astype(np.int16)
    starts = range(0, len(members), LIST)
    for i in starts:
        yield members[i : i + LIST], members[:0]
        for j in range(i + LIST, len(members), LIST):
            if cls[j] - cls[min(i + LIST, len(members)) - 1] > reach:
                break
            yield members[i : i + LIST], members[j : j + LIST]


def _across(left: np.ndarray, right: np.ndarray, reach: int) -> Iterator[np.ndarray]:
    """Pairs of one group of each block that are near enough in size, the smaller number first."""
    for at in range(0, len(left), 256):
        a, b = (x.ravel() for x in np.meshgrid(left[at : at + 256], right, indexing="ij"))
        near = np.abs((a & np.uint64(0xFF)).astype(np.int16) - (b & np.uint64(0xFF)).astype(np.int16)) <= reach
        yield np.stack([np.minimum(a[near], b[near]), np.maximum(a[near], b[near])], axis=1)


def _counted_pairs(groups: np.ndarray, starts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that meet in the runs of ``groups``, and how often."""
    held, times, n, limit = [], [], 0, COUNTED_PAIRS
    for pairs in _meetings(groups, starts, reach):
        held.append(pairs)
        times.append(np.ones(len(pairs), np.int64))
        n += len(pairs)
        if n > limit:
            held, times = ([x] for x in _added_up(held, times))
            limit = max(COUNTED_PAIRS, 2 * len(held[0]))
            n = len(held[0])
    return _added_up(held, times)


def _by_part(pairs: np.ndarray, times: np.ndarray, bits: int) -> list[tuple]:
    """Ascending pairs by the part that adds them up: first members, how often each comes, second members, times (up to 65535)."""
    part = (_mix(pairs[:, 0] * _PLACE[0] + pairs[:, 1]) >> np.uint64(64 - bits)).astype(np.int32)
    by = np.argsort(part, kind="stable")
    pairs, times = pairs[by], np.minimum(times[by], 65535).astype(np.uint16)
    edges = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << bits))]).tolist()
    out = []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a < b:
            first, runs = np.unique(pairs[a:b, 0], return_counts=True)
            out.append((k, first.tobytes(), runs.astype(np.uint32).tobytes(), np.ascontiguousarray(pairs[a:b, 1]).tobytes(), times[a:b].tobytes()))
    return out


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    """Rows of a part and blobs."""
    return pa.table({n: pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k, n in enumerate(names)})


def group_pairs(docs: DataFrame, order: Order, led: Leaders, threshold: float) -> DataFrame:
    """Pairs of groups that share enough n-grams of their prefixes and are near enough in size."""
    bits = order.bits
    reach = math.ceil(math.log(1 / threshold) / math.log(_RATIO)) + 1

    def index(batches):
        schema = pa.schema([("part", pa.int32()), ("grams", pa.binary()), ("groups", pa.binary())])
        held, seen, wide, n = [], set(), {}, 0

        def send():
            every = held + [(np.unique(np.concatenate(p)), g) for g, p in wide.items()]
            grams = np.concatenate([p for p, _ in every])
            groups = np.repeat(np.array([g for _, g in every], np.uint64), [len(p) for p, _ in every])
            by = np.argsort(grams)
            grams, groups = grams[by], groups[by]
            return as_batch(list(zip(*((k, _short(grams[s], bits).tobytes(), groups[s].tobytes()) for k, s in _parts(grams, bits)))), schema)

        for batch in batches:
            for part in slices(batch, limit=GRAM_BYTES):
                for found in _described(part.column("text"), order, led, threshold):
                    if found and found[4]:
                        wide.setdefault(found[3], []).append(found[2].copy())
                        n += len(found[2])
                    elif found and found[3] not in seen:
                        seen.add(found[3])
                        held.append((found[2].copy(), found[3]))
                        n += len(found[2])
                if n > GATHERED:
                    yield send()
                    held, seen, wide, n = [], set(), {}, 0
        if n:
            yield send()
            held.clear()
            wide.clear()
        tidy()

    def meet(group: pa.Table) -> pa.Table:
        grams, groups = _joined(group.column("grams"), np.uint32), _joined(group.column("groups"), np.uint64)
        by = np.lexsort((groups, grams))
        grams, groups = grams[by], groups[by]
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (groups[1:] != groups[:-1])
        grams, groups = grams[fresh], groups[fresh]
        starts = np.unique(grams, return_index=True)[1]
        sizes = np.diff(np.concatenate([starts, [len(groups)]]))
        long = sizes > FREQUENT
        lists: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for at, n in zip(starts[long].tolist(), sizes[long].tolist()):
            for x, y in _blocks(groups[at : at + n], reach):
                home = _mix(x[:1] * _PLACE[0] + (y[:1] if len(y) else x[:1])) >> np.uint64(64 - bits)
                lists.setdefault(int(home[0]), []).append((np.sort(x), y))
        short = np.repeat(~long, sizes)
        n = sizes[~long]
        found = _by_part(*_counted_pairs(groups[short], np.concatenate([[0], np.cumsum(n)])[:-1], reach), bits)
        kept = [(k, None, None, None, None, np.array([len(z) for pair in own for z in pair], np.uint32).tobytes(), np.concatenate([z for pair in own for z in pair]).tobytes()) for k, own in lists.items()]
        return _table([(*row, None, None) for row in found] + kept, ["part", "first", "runs", "second", "times", "sizes", "members"])

    def at_home(group: pa.Table) -> pa.Table:
        members = np.split(_joined(group.column("members"), np.uint64), np.cumsum(_joined(group.column("sizes"), np.uint32).astype(np.int64))[:-1])
        own = [x for x, y in zip(members[::2], members[1::2]) if not len(y)]
        flat, sizes = np.concatenate([*own, members[0][:0]]), [len(x) for x in own]
        found = [_counted_pairs(flat, np.cumsum([0, *sizes])[:-1], reach)] if own else []
        n = 0
        for x, y in zip(members[::2], members[1::2]):
            for pairs in _across(x, y, reach) if len(y) else ():
                found.append((pairs, np.ones(len(pairs), np.int64)))
                n += len(pairs)
                if n > COUNTED_PAIRS:
                    found, n = [_added_up(*map(list, zip(*found)))], 0
        tidy()
        return _table(_by_part(*_added_up(*map(list, zip(*found))), bits), ["part", "first", "runs", "second", "times"])

    def once(group: pa.Table) -> pa.Table:
        first = np.repeat(_joined(group.column("first"), np.uint64), _joined(group.column("runs"), np.uint32))
        pairs, times = _added_up([np.stack([first, _joined(group.column("second"), np.uint64)], axis=1)], [_joined(group.column("times"), np.uint16)])
        pairs = pairs[times >= _least_meetings(pairs, threshold)].astype(np.int64)
        return pa.table({"grp": pa.array(np.ascontiguousarray(pairs[:, 0])), "other": pa.array(np.ascontiguousarray(pairs[:, 1]))})

    blobs = "part int, first binary, runs binary, second binary, times binary"
    met = docs.select("text").mapInArrow(index, "part int, grams binary, groups binary").groupBy("part").applyInArrow(meet, blobs + ", sizes binary, members binary")
    met = stored(met, "ngram-meetings")
    # few bytes, but much to do: a given number of partitions is not put together
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    homes = met.where("sizes IS NOT NULL").select("part", "sizes", "members").repartition(wide, "part").groupBy("part").applyInArrow(at_home, blobs)
    return met.where("sizes IS NULL").drop("sizes", "members").unionByName(homes).groupBy("part").applyInArrow(once, "grp long, other long")


def candidates(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of distinct sets of different candidate groups, to verify."""
    own = sets.select("grp", "digest", "size")
    right = sets.select(F.col("grp").alias("other"), F.col("digest").alias("digest2"), F.col("size").alias("size2"))
    across = pairs.join(own, "grp").join(right, "other")
    return across.select("digest", "size", "digest2", "size2").where(F.least("size", "size2") >= F.greatest("size", "size2") * F.lit(threshold) - 1e-9)


def _placed(found: DataFrame) -> DataFrame:
    """The pairs, each with a place to compare it.

    Pairs are laid out in blocks of sets around the first partner of their right
    side, so a set travels once to each block that needs it, not once a pair.
    """
    found = stored(found, "ngram-candidates")
    places = max(16, found.count() // PLACE_PAIRS)
    found = stored(found.join(found.groupBy("digest2").agg(F.min("digest").alias("centre")), "digest2"), "ngram-centres")
    # only centres of very many pairs take several blocks, so there are few of them
    wide = found.groupBy("centre").count().where(F.col("count") > BLOCK * BLOCK // 2).select("centre", F.ceil(F.sqrt(2.0 * F.col("count")) / BLOCK).alias("blocks"))
    found = join_side(found, wide, "centre", "left", 16).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    of = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    place = F.pmod(F.xxhash64("centre", of("digest"), of("digest2")), F.lit(places)).cast("int")
    return found.select(place.alias("place"), "digest", "digest2", "size", "size2")


def _needed(placed: DataFrame) -> DataFrame:
    """(digest, place): where each set is compared."""
    ends = F.explode(F.array("digest", "digest2"))
    return placed.select(ends.alias("digest"), F.col("place").alias("place")).distinct()


def _by_bitmap(bitmaps: DataFrame, placed: DataFrame, threshold: float) -> DataFrame:
    """The placed pairs whose bitmaps let them be alike."""

    def compare(pairs: pa.Table, own: pa.Table) -> pa.Table:
        by = dict(zip(own.column("digest").to_pylist(), own.column("bitmap").to_pylist()))
        apart = np.array([bits_apart(by[x], by[y]) for x, y in zip(pairs.column("digest").to_pylist(), pairs.column("digest2").to_pylist())], np.int64)
        size = pairs.column("size").to_numpy().astype(np.int64) + pairs.column("size2").to_numpy()
        tidy()
        return pairs.filter(pa.array((size - apart) / 2 >= threshold / (1 + threshold) * size - 1e-6))

    at = _needed(placed).join(bitmaps, "digest")
    return placed.groupBy("place").cogroup(at.groupBy("place")).applyInArrow(compare, placed.schema)


def _grams_of(own: pa.Table) -> dict[int, np.ndarray]:
    """The sets of (digest, text) rows by digest; another row with the same doc_id has another text, and is passed over."""
    by = {}
    for batch in own.select(["digest", "text"]).to_batches():
        for part in slices(batch, limit=GRAM_BYTES):
            grams, edges = gram_sets(part.column("text"))
            for digest, a, b in zip(part.column("digest").to_pylist(), edges[:-1].tolist(), edges[1:].tolist()):
                if digest not in by and _digest(grams[a:b]) == digest:
                    by[digest] = grams[a:b].copy()
    return by


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (a, b) if len(a) < len(b) else (b, a)
    overlap = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return overlap / (len(a) + len(b) - overlap)


class _Forest:
    """Links of sets, counted, and the least set that each hangs together with."""

    def __init__(self):
        self.links: dict[int, int] = {}
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[y] = self.up.setdefault(y, y)
            x = self.up[x]
        return x

    def add(self, x: int, y: int) -> None:
        for z in (x, y):
            self.links[z] = self.links.get(z, 0) + 1
        low, high = sorted((self.root(x), self.root(y)))
        self.up[high] = low

    def add_all(self, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> None:
        """Links between sets of ``left`` and of ``right`` where ``near`` says so."""
        for own, links in ((left, near.sum(axis=1)), (right, near.sum(axis=0))):
            for x, n in zip(own[links > 0].tolist(), links[links > 0].tolist()):
                self.links[x] = self.links.get(x, 0) + n
        most = np.iinfo(np.int64).max
        rows, columns, before = left.copy(), right.copy(), None
        while before is None or (rows != before).any():  # the least number goes around
            before = rows
            columns = np.minimum(columns, np.where(near, rows[:, None], most).min(axis=0))
            rows = np.minimum(rows, np.where(near, columns, most).min(axis=1))
        for own, least in ((left, rows), (right, columns)):
            for x, y in zip(own[own != least].tolist(), least[own != least].tolist()):
                low, high = sorted((self.root(x), self.root(y)))
                self.up[high] = low

    def table(self) -> pa.Table:
        return pa.table({"digest": pa.array(list(self.links), pa.int64()), "links": pa.array(list(self.links.values()), pa.int64()), "root": pa.array([self.root(x) for x in self.links], pa.int64())})


_PAIRS, _LINKS = "digest long, digest2 long, jaccard double", "digest long, links long, root long"


def _collect(alike: Iterator[tuple[int, int, float]], pairs: bool) -> pa.Table:
    """Alike sets as pairs, or as links counted and a forest."""
    if pairs:
        rows = list(zip(*alike)) or [(), (), ()]
        return pa.table({"digest": pa.array(rows[0], pa.int64()), "digest2": pa.array(rows[1], pa.int64()), "jaccard": pa.array(rows[2], pa.float64())})
    forest = _Forest()
    for x, y, _ in alike:
        forest.add(x, y)
    return forest.table()


def _texts(docs: DataFrame, reps: DataFrame, wanted: DataFrame, row_bytes: int = 64) -> DataFrame:
    """The rows of ``wanted`` (digest and more) with their set's text. Texts travel, as they are smaller than their sets."""
    more = [c for c in wanted.columns if c != "digest"]
    needs = wanted.join(reps, "digest").groupBy("rep").agg(F.collect_list(F.struct("digest", *more)).alias("wanted")).withColumnRenamed("rep", "doc_id")
    return join_side(docs, needs, "doc_id", "inner", row_bytes).select("text", F.explode("wanted").alias("w")).select("text", "w.*")


def verify(docs: DataFrame, reps: DataFrame, bitmaps: DataFrame, found: DataFrame, threshold: float, pairs: bool) -> DataFrame:
    """Of the candidate pairs, those whose whole sets are alike."""
    placed = stored(_by_bitmap(bitmaps, stored(_placed(found), "ngram-placed"), threshold), "ngram-near")

    def compare(near: pa.Table, own: pa.Table) -> pa.Table:
        by = _grams_of(own)
        each = ((x, y, _jaccard(by[x], by[y])) for x, y in zip(near.column("digest").to_pylist(), near.column("digest2").to_pylist()))
        out = _collect((z for z in each if z[2] >= threshold - 1e-12), pairs)
        del by
        tidy()
        return out

    texts = _texts(docs, reps, _needed(placed))
    return placed.groupBy("place").cogroup(texts.groupBy("place")).applyInArrow(compare, _PAIRS if pairs else _LINKS)


def _crowds(pairs: DataFrame, several: DataFrame) -> DataFrame:
    """(grp, other, crowd): the pairs of groups, and the sets of the larger, which comes first."""
    own = several.select("grp", F.col("count").alias("n"))
    pairs = join_side(join_side(pairs, own, "grp", "left", 16), own.toDF("other", "m"), "other", "left", 16)
    pairs = pairs.select("grp", "other", *(F.coalesce(c, F.lit(1)).alias(c) for c in ("n", "m")))
    swap = F.col("m") > F.col("n")
    return pairs.select(F.when(swap, F.col("other")).otherwise(F.col("grp")).alias("grp"), F.when(swap, F.col("grp")).otherwise(F.col("other")).alias("other"), F.greatest("n", "m").alias("crowd"))


def _tiles_within(sets: DataFrame, several: DataFrame) -> DataFrame:
    """(digest, tile, side, same): the sets of each group in pairs of its blocks; ``same`` where a block meets itself."""
    own = sets.select("grp", "digest").join(several.select("grp", F.ceil(F.col("count") / BLOCK).alias("blocks")), "grp").withColumn("b", F.pmod(F.xxhash64("digest"), "blocks"))
    own = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.select("digest", F.xxhash64("grp", F.least("b", "k"), F.greatest("b", "k")).alias("tile"), (F.col("b") > F.col("k")).alias("side"), F.expr("b = k").alias("same"))


def _tiles_between(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(digest, tile, side, same): the sets of each larger group in blocks, with blocks of the sets of its partners."""
    own = sets.select("grp", "digest")
    partners = pairs.join(own.toDF("other", "digest"), "other").select("grp", "digest")
    blocks = partners.groupBy("grp").count().withColumnRenamed("count", "m").join(pairs.select("grp", "crowd").distinct(), "grp")
    blocks = checkpoint(blocks.select("grp", F.ceil(F.col("crowd") / BLOCK).alias("rows"), F.ceil(F.col("m") / BLOCK).alias("columns")))

    def side(of: DataFrame, right: bool) -> DataFrame:
        mine, others = ("columns", "rows") if right else ("rows", "columns")
        of = of.join(blocks, "grp").withColumn("b", F.pmod(F.xxhash64("digest"), mine)).withColumn("k", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return of.select("digest", F.xxhash64("grp", *(("k", "b") if right else ("b", "k")), F.lit("between")).alias("tile"), F.lit(right).alias("side"), F.lit(False).alias("same"))

    return side(own, False).unionByName(side(partners, True))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of ``left`` shares with each of ``right``."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.int64)

    def bits(sets: list[np.ndarray], flat: np.ndarray, some: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(some, flat), len(some) - 1)
        found = some[at] == flat
        plain = np.zeros((len(sets), -(-len(some) // 64) * 64), bool)
        plain[row[found], at[found]] = True
        return np.packbits(plain, axis=1).view(np.uint64)

    for k in range(0, len(shared), 1 << 14):  # so many columns at once
        x, y = (bits(sets, flat, shared[k : k + (1 << 14)]) for sets, flat in ((left, a), (right, b)))
        for w in range(x.shape[1]):
            out += np.bitwise_count(x[:, w, None] & y[None, :, w])
    return out


def tiled(docs: DataFrame, tiles: DataFrame, reps: DataFrame, threshold: float, pairs: bool) -> DataFrame:
    """The alike sets of tiles, in each of which all of one side meet all of the other, or one another."""
    tiles = stored(tiles, "ngram-tiles")
    rows, different = tiles.agg(F.count("*"), F.countDistinct("digest")).first()
    places = max(16, rows // BLOCK)
    tiles = tiles.withColumn("place", F.pmod("tile", F.lit(places)).cast("int"))

    def compare(own: pa.Table) -> pa.Table:
        by = _grams_of(own)
        of: dict[tuple[int, bool], tuple[set[int], set[int]]] = {}
        for tile, side, same, digest in zip(*(own.column(n).to_pylist() for n in ("tile", "side", "same", "digest"))):
            if digest in by:
                of.setdefault((tile, same), (set(), set()))[side].add(digest)

        def met():
            for (_, same), (left, right) in of.items():
                x, y = sorted(left), sorted(left if same else right)
                if x and y:
                    one, other = ([by[d] for d in z] for z in (x, y))
                    shared = _overlaps(one, other)
                    jaccard = shared / (np.array([len(z) for z in one])[:, None] + np.array([len(z) for z in other]) - shared)
                    yield np.array(x), np.array(y), np.triu(jaccard, 1) if same else jaccard

        if pairs:
            out = _collect(((x[i], y[j], z[i, j]) for x, y, z in met() for i, j in np.argwhere(z >= threshold - 1e-12)), True)
        else:
            forest = _Forest()
            for x, y, z in met():
                forest.add_all(x, y, z >= threshold - 1e-12)
            out = forest.table()
        del by
        tidy()
        return out

    return _texts(docs, reps, tiles, 64 + 32 * (rows // max(1, different))).groupBy("place").applyInArrow(compare, _PAIRS if pairs else _LINKS)


def _similar(docs: DataFrame, threshold: float, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows as described, members and distinct sets, and what is alike of these: pairs, or links and forests."""
    docs = id_text(docs).where("doc_id is not null")
    texts = docs.where("text is not null")
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    order, led = frequent(texts, _bits(size or 0)), leaders(texts, n)
    rows = described(docs, order, led, threshold)
    members = checkpoint(members_of(rows))
    sets = checkpoint(sets_of(members))
    reps = sets.select("digest", "rep")
    bitmaps = rows.where("size > 0").select("digest", F.col("doc_id").alias("rep"), "bitmap").join(reps, ["digest", "rep"], "left_semi").dropDuplicates(["digest"]).select("digest", "bitmap")
    several = checkpoint(sets.groupBy("grp").count().where("count > 1"))
    met = stored(_crowds(group_pairs(texts, order, led, threshold), several), "ngram-pairs")
    tiles = _tiles_within(sets, several).unionByName(_tiles_between(sets, met.where(F.col("crowd") > CROWD)))
    found = candidates(sets, met.where(F.col("crowd") <= CROWD).select("grp", "other"), threshold)
    near = verify(texts, reps, bitmaps, found, threshold, pairs).unionByName(tiled(texts, tiles, reps, threshold, pairs))
    return rows, members, sets, near


def similar(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of documents with a Jaccard index of at least ``threshold``, as bicliques."""
    _, members, sets, pairs = _similar(docs, threshold, True)
    ids = members.groupBy("digest").agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    ids = checkpoint(ids)
    near = pairs.join(ids.select("digest", F.col("ids").alias("a")), "digest").join(ids.select(F.col("digest").alias("digest2"), F.col("ids").alias("b")), "digest2")
    swap = F.col("a")[0] > F.col("b")[0]
    near = near.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("left_ids"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("right_ids"), "jaccard")
    equal = ids.where(F.size("ids") > 1).select(F.col("ids").alias("left_ids"), F.col("ids").alias("right_ids"), F.lit(1.0).alias("jaccard"))
    return near.unionByName(equal)


def components(edges: DataFrame) -> DataFrame:
    """(node, first): the smallest node of each node's component, for nodes of ``edges`` (u, v) that aren't the smallest."""
    edges = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while not edges.isEmpty():
        # every larger neighbour of u goes to the least around u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # then u and its smaller neighbours go to the least of them
        large = checkpoint(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("first"))


def _with_sets(members: DataFrame, known: DataFrame) -> DataFrame:
    """Join members with what is known of their sets; of a set that a thousandth of all members have, by a broadcast, so that no task gets them all."""
    most = max(1000, members.count() // 1000)
    hot = checkpoint(known.where(F.col("documents") > most))  # at most a thousand
    common = members.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(known, "digest")
    return members.join(F.broadcast(hot), "digest").unionByName(common)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each doc_id: its class, the other documents with an equal set, and the different sets that are alike."""
    rows, members, sets, near = _similar(docs, threshold, False)
    near = stored(near, "ngram-links")
    reps = sets.select("digest", "rep")
    roots = near.where("digest <> root").select("digest", "root").join(reps, "digest").join(reps.select(F.col("digest").alias("root"), F.col("rep").alias("other")), "root")
    members = members.select("doc_id", "digest")
    # the sets of a document with several are one
    several = members.groupBy("doc_id").count().where("count > 1").select("doc_id")
    own = join_side(members, several, "doc_id", "left_semi", 16).join(reps, "digest").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    first = components(roots.select(F.col("rep").alias("u"), F.col("other").alias("v")).unionByName(own))
    known = sets.join(near.groupBy("digest").agg(F.sum("links").alias("links")), "digest", "left").join(first.withColumnRenamed("node", "rep"), "rep", "left")
    known = checkpoint(known.select("digest", "documents", F.coalesce("first", "rep").alias("class_id"), (F.col("documents") - 1).alias("copies"), F.coalesce("links", F.lit(0)).cast("long").alias("links")))
    columns = ["doc_id", "class_id", "copies", "links"]
    bare = rows.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"))
    every = _with_sets(members, known).select(columns).unionByName(bare)
    return every.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("copies").alias("copies"), F.sum("links").alias("links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without those that are alike, over any number of steps, to one with a smaller doc_id."""
    return without(docs, checkpoint(classes(docs, threshold).where("doc_id <> class_id").select("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def _words(column: str) -> str:
    return f"string_split(trim(regexp_replace(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' '), ' ')"


SQL = f"""
WITH RECURSIVE row_of AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE doc_id IS NOT NULL),
doc AS (SELECT r, doc_id, w FROM (SELECT r, doc_id, {_words('text')} AS w FROM row_of WHERE text IS NOT NULL) WHERE w <> ['']),
gram AS (SELECT DISTINCT r, array_to_string(w[k:k + {WORDS - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) AS k FROM doc)),
one AS (SELECT r, list_sort(list(g)) AS gs FROM gram GROUP BY r),
sets AS (SELECT min(r) AS s, min(doc_id) AS rep, count(DISTINCT doc_id) AS documents, gs FROM one JOIN doc USING (r) GROUP BY gs),
member AS (SELECT DISTINCT doc_id, s FROM one JOIN doc USING (r) JOIN sets USING (gs)),
own AS (SELECT s, len(gs) AS n, unnest(gs) AS g FROM sets),
shared AS (SELECT a.s AS x, b.s AS y, a.n AS n, b.n AS m, count(*) AS o FROM own a JOIN own b ON a.g = b.g AND a.s <> b.s GROUP BY ALL),
near AS (SELECT x, y FROM shared WHERE CAST(o AS DOUBLE) / (n + m - o) >= {THRESHOLD - 1e-12!r}),
link AS (SELECT x AS s, count(*) AS links FROM near GROUP BY x),
edge AS (SELECT a.rep AS u, b.rep AS v FROM near JOIN sets a ON a.s = x JOIN sets b ON b.s = y
         UNION SELECT doc_id, rep FROM member JOIN sets USING (s) UNION SELECT rep, doc_id FROM member JOIN sets USING (s)),
reach(u, v) AS (SELECT u, v FROM edge UNION SELECT reach.u, edge.v FROM reach JOIN edge ON reach.v = edge.u),
known AS (SELECT doc_id, sum(documents - 1) AS copies, sum(coalesce(links, 0)) AS links FROM member JOIN sets USING (s) LEFT JOIN link USING (s) GROUP BY doc_id)
SELECT doc_id, CAST(least(doc_id, coalesce((SELECT min(v) FROM reach WHERE u = doc_id), doc_id)) AS BIGINT) AS class_id,
       CAST(coalesce(any_value(copies), 0) AS BIGINT) AS copies, CAST(coalesce(any_value(links), 0) AS BIGINT) AS links
FROM row_of LEFT JOIN known USING (doc_id) GROUP BY doc_id
"""
