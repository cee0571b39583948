"""URL filter over a sorted array of digests.

A block list has domains (``bad.example.com``: the host and all below it), paths
(``site.org/spam``: the page and all below it) and whole URLs with a query. All are
written in one canonical form: no scheme, user, default port, fragment, trailing
slash or ``utm_`` parameter; the host in lower case without a trailing dot.

The list is stored in the shared folder as shards of three arrays: xxhash64
digests in ascending order, offsets, and the entries themselves end to end.
Workers map these into memory, look up all candidates of a batch of URLs (the URL,
its parent paths, its host and parent domains) by vectorised binary search, and
compare the stored entry wherever a digest is found, so a collision blocks nothing.
The digests of a URL's parent paths come from one running hash, so a URL costs time in
proportion to its length, whatever its depth. Where the shared folder is no file system
that can be mapped, the arrays are rows there, and the distinct digests of all candidates
go to the shards and are searched in them in the same way.

Of several entries that match, the longest is reported (no two are equally long, as
each is a part of the next). Defined cases: a null, empty or hostless URL matches nothing and
stays, as does one whose host is longer than the 253 characters of a name; null and empty entries
are left out, repeated ones count once; an empty
list blocks nothing; URLs are taken whole at any length; repeated rows stay
repeated; an empty table gives no rows; further columns may have any name.

The list of the query: ``DOMAINS``, and for each of ``HOSTS`` and ``LANGUAGES`` every third page
number up to ``NUMBERS`` as a path and the number after it as a whole URL with a query, and
``DOMAINS_MORE`` numbered domains that fill it up to some 840,000 entries in several shards.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, checkpoint, fresh_path, join_side, local_path, pick, slices, stored, table

#: Entries of one shard, about.
SHARD = 1 << 18
SCHEMA = "page_id long, url string, entry string, blocked boolean"
#: Domains that the query blocks.
DOMAINS = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]
HOSTS, LANGUAGES = ("tionsh.example.net", "blog.ththth.example.org", "m.thther.example.org", "www.therin.example.net"), ("en", "de", "fr", "es")
NUMBERS, DOMAINS_MORE = 60_000, 200_000
#: Characters of a host name at most.
LONGEST_HOST = 253

_URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?", re.S)


def canonical(url: str | None) -> tuple[str, str, str] | None:
    """Host, path and query of a URL, each in canonical form; None without a host."""
    found = _URL.match(url.strip()) if url else None
    if not found:
        return None
    host, port, path, query = found[1].lower().rstrip("."), found[2], found[3], found[4] or ""
    if not host or len(host) > LONGEST_HOST:
        return None
    if port and port not in ("80", "443"):
        host += ":" + port
    query = "&".join(p for p in query.split("&") if p and not p.startswith("utm_"))
    return host, path.rstrip("/"), query


def written(url: str | None) -> str | None:
    """A URL or block list entry in canonical form."""
    c = canonical(url)
    return c and c[0] + c[1] + ("?" + c[2] if c[2] else "")


def _domains(host: str) -> list[str]:
    """The host as an entry may have it: with its port, without, and the domains above it."""
    bare, _, port = host.partition(":")
    labels = bare.split(".")
    return [host] * bool(port) + [".".join(labels[k:]) for k in range(len(labels))]


class Probes:
    """What an entry may be that blocks a URL, longest first: digests, and the text of any of them."""

    def __init__(self, url: str | None):
        self.digests: list[int] = []
        c = canonical(url)
        if not c:
            return
        host, path, query = c
        self.domains = _domains(host)
        self.whole = host + path
        running = xxhash.xxh64(host.encode("utf-8", "surrogatepass"), seed=42)
        self.ends: list[int] = []
        found, at = [], 0
        while path:
            to = path.find("/", at + 1)
            to = len(path) if to < 0 else to
            running.update(path[at:to].encode("utf-8", "surrogatepass"))
            found.append(running.intdigest())
            self.ends.append(len(host) + to)
            if to == len(path):
                break
            at = to
        self.ends.reverse()
        self.query = "?" + query if query else ""
        self.digests = [digest(self.whole + self.query)] * bool(query) + found[::-1] + [digest(d) for d in self.domains]

    def text(self, k: int) -> str:
        if self.query:
            if k == 0:
                return self.whole + self.query
            k -= 1
        return self.whole[: self.ends[k]] if k < len(self.ends) else self.domains[k - len(self.ends)]


def candidates(url: str | None) -> list[str]:
    """What an entry may be that blocks this URL, longest first."""
    p = Probes(url)
    return [p.text(k) for k in range(len(p.digests))]


def digest(entry: str) -> int:
    return xxhash.xxh64_intdigest(entry.encode("utf-8", "surrogatepass"), seed=42)


class Shard:
    """Sorted digests and their entries, mapped into memory."""

    def __init__(self, folder: str):
        size = os.path.getsize(f"{folder}/digests") // 8
        load = lambda name, kind, n: np.memmap(f"{folder}/{name}", kind, "r", shape=(n,)) if n else np.zeros(0, kind)
        self.digests, self.offsets = load("digests", "<u8", size), load("offsets", "<i8", size + 1)
        self.entries = load("entries", np.uint8, os.path.getsize(f"{folder}/entries"))

    @staticmethod
    def write(folder: str, entries: list[str]) -> int:
        """Whole or not at all, so a task that is run again does no harm."""
        digests, offsets, flat = _arrays(entries)
        part = f"{folder}.{os.getpid()}.{os.urandom(4).hex()}"
        os.makedirs(part)
        digests.tofile(f"{part}/digests")
        offsets.tofile(f"{part}/offsets")
        with open(f"{part}/entries", "wb") as f:
            f.write(flat)
        try:
            os.rename(part, folder)
        except OSError:  # another attempt was first
            if not os.path.isdir(folder):
                raise
        return len(digests)

    def among(self, digests: np.ndarray) -> np.ndarray:
        """Which of ``digests`` the shard has."""
        at = np.searchsorted(self.digests, digests)
        out = at < len(self.digests)
        out[out] = self.digests[at[out]] == digests[out]
        return out

    def confirm(self, number: int, entry: str) -> bool:
        """Whether the entry itself is stored under its digest."""
        return entry.encode("utf-8", "surrogatepass") in self.stored(number)

    def stored(self, number: int) -> list[bytes]:
        """The entries of a digest."""
        a, b = np.searchsorted(self.digests, np.uint64(number)), np.searchsorted(self.digests, np.uint64(number), "right")
        return [self.entries[self.offsets[k] : self.offsets[k + 1]].tobytes() for k in range(int(a), int(b))]

    def has(self, probes: list[str], digests: np.ndarray) -> np.ndarray:
        """Which of ``probes`` are entries."""
        out = self.among(digests)
        for i in np.flatnonzero(out).tolist():
            out[i] = self.confirm(int(digests[i]), probes[i])
        return out


@functools.lru_cache(maxsize=64)
def _shard(folder: str) -> Shard:
    return Shard(folder)


class Index:
    """All shards of one block list; a digest's top bits name its shard."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits

    def _shards(self, digests: np.ndarray) -> Iterator[tuple[Shard, np.ndarray]]:
        """The shards that are there, and where in ``digests`` theirs are."""
        which = _shard_of(digests, self.bits)
        for k in np.unique(which).tolist():
            path = f"{self.folder}/{k}"
            if os.path.isdir(path):
                yield _shard(path), np.flatnonzero(which == k)

    def has(self, probes: list[str]) -> np.ndarray:
        digests = np.array([digest(p) for p in probes], np.uint64)
        out = np.zeros(len(probes), bool)
        for shard, at in self._shards(digests):
            out[at] = shard.has([probes[i] for i in at.tolist()], digests[at])
        return out

    def longest(self, urls: list[str | None]) -> list[str | None]:
        """The longest entry that blocks each URL."""
        tried = [Probes(u) for u in urls]
        upto = np.cumsum([0, *(len(p.digests) for p in tried)])
        digests = np.fromiter((d for p in tried for d in p.digests), np.uint64, int(upto[-1]))
        hits: list[tuple[int, Shard]] = []
        for shard, at in self._shards(digests):
            hits += [(i, shard) for i in at[shard.among(digests[at])].tolist()]
        out: list[str | None] = [None] * len(urls)
        for i, shard in sorted(hits, key=lambda x: x[0]):
            k = int(np.searchsorted(upto, i, "right")) - 1
            if out[k] is None and shard.confirm(int(digests[i]), text := tried[k].text(i - int(upto[k]))):
                out[k] = text
        return out


def _shard_of(digests: np.ndarray, bits: int) -> np.ndarray:
    return (digests >> np.uint64(64 - bits)) if bits else np.zeros(len(digests), np.uint64)


def entries_of(listed: DataFrame) -> DataFrame:
    """The distinct canonical entries of a list (column ``entry``)."""

    def run(batches):
        schema = pa.schema([("entry", pa.string())])
        for batch in batches:
            yield as_batch([[e for x in batch.column(0).to_pylist() if (e := written(x))]], schema)

    return pick(listed, entry="string").mapInArrow(run, "entry string").distinct()


def _arrays(entries: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Digests in ascending order, offsets, and the entries end to end."""
    pairs = sorted({(digest(e), e.encode("utf-8", "surrogatepass")) for e in entries})
    return np.array([d for d, _ in pairs], "<u8"), np.cumsum([0, *(len(e) for _, e in pairs)], dtype="<i8"), b"".join(e for _, e in pairs)


def _split(listed: DataFrame, shard: int) -> tuple[DataFrame, int]:
    """(entry, shard) for the distinct entries, and the number of bits that name a shard."""
    entries = checkpoint(entries_of(listed))
    bits = max(0, (entries.count() - 1) // shard).bit_length()
    top = F.shiftrightunsigned(F.xxhash64("entry"), 64 - bits) if bits else F.lit(0)
    return entries.select("entry", top.cast("int").alias("shard")), bits


def build(listed: DataFrame, shard: int = SHARD) -> Index | None:
    """Write a list's shards, each by one task; None where the shared folder can't be mapped."""
    folder = local_path(fresh_path(listed.sparkSession, "url-list"))
    if folder is None:
        return None
    entries, bits = _split(listed, shard)
    os.makedirs(folder, exist_ok=True)

    def write(key: tuple, group: pa.Table) -> pa.Table:
        k = key[0].as_py()
        return pa.table({"shard": pa.array([k], pa.int32()), "n": pa.array([Shard.write(f"{folder}/{k}", group.column("entry").to_pylist())], pa.int64())})

    entries.groupBy("shard").applyInArrow(write, "shard int, n long").collect()
    return Index(folder, bits)


def check(pages: DataFrame, listed: DataFrame, mapped: bool = True) -> DataFrame:
    """One row for each page: the entry that blocks its URL, if any."""
    pages = pick(pages, page_id="long", url="string")
    index = build(listed) if mapped else None
    if index is None:
        return _check_in_rows(pages, listed)

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("entry", pa.string()), ("blocked", pa.bool_())])
        for batch in batches:
            for part in slices(batch, "url"):
                best = index.longest(part.column("url").to_pylist())
                yield as_batch([part.column("page_id"), part.column("url"), best, [b is not None for b in best]], schema)

    return pages.mapInArrow(run, SCHEMA)


def _check_in_rows(pages: DataFrame, listed: DataFrame, shard: int = SHARD) -> DataFrame:
    """The same over arrays that are rows of the shared store: the candidates' distinct digests go to the shards."""
    entries, bits = _split(listed, shard)

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        digests, offsets, flat = _arrays(group.column("entry").to_pylist())
        row = [[key[0].as_py()], [digests.tobytes()], [offsets.tobytes()], [flat]]
        return pa.table([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "digests", "offsets", "entries"])

    def tried(batches):
        schema = pa.schema([("id", pa.int64()), ("nth", pa.int32()), ("digest", pa.int64()), ("shard", pa.int32())])
        for batch in batches:
            for part in slices(batch, "url", 1 << 18):
                rows = [(i, n, d) for i, u in zip(part.column("id").to_pylist(), part.column("url").to_pylist()) for n, d in enumerate(Probes(u).digests)]
                digests = np.array([d for _, _, d in rows], np.uint64)
                yield as_batch([[i for i, _, _ in rows], [n for _, n, _ in rows], digests.astype(np.int64), _shard_of(digests, bits).astype(np.int32)], schema)

    def search(wanted: pa.Table, own: pa.Table) -> pa.Table:
        found: list[tuple[int, bytes]] = []
        digests = wanted.column("digest").to_numpy().astype(np.uint64)
        for row in own.to_pylist():
            arrays = object.__new__(Shard)
            arrays.digests, arrays.offsets, arrays.entries = (np.frombuffer(row[n], t) for n, t in (("digests", "<u8"), ("offsets", "<i8"), ("entries", np.uint8)))
            found += [(d, e) for d in digests[arrays.among(digests)].tolist() for e in arrays.stored(d)]
        return pa.table({"digest": pa.array(np.array([d for d, _ in found], np.uint64).astype(np.int64)), "entry": pa.array([e.decode("utf-8", "replace") for _, e in found], pa.string())})

    def confirm(batches):
        schema = pa.schema([("url", pa.string()), ("nth", pa.int32()), ("entry", pa.string())])
        for batch in batches:
            rows = [(u, n, e) for u, n, e in zip(*(batch.column(c).to_pylist() for c in ("url", "nth", "entry"))) if Probes(u).text(n) == e]
            yield as_batch(list(zip(*rows)) or [[], [], []], schema)

    shards = stored(entries.groupBy("shard").applyInArrow(pack, "shard int, digests binary, offsets binary, entries binary"), "url-shards")
    urls = stored(pages.where("url is not null").select("url").distinct().withColumn("id", F.monotonically_increasing_id()), "urls")
    probes = stored(urls.mapInArrow(tried, "id long, nth int, digest long, shard int"), "url-probes")
    found = probes.select("shard", "digest").distinct().groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(search, "digest long, entry string")
    hits = join_side(probes, found, "digest", "inner", 100).select("id", "nth", "entry").join(urls, "id").select("url", "nth", "entry").mapInArrow(confirm, "url string, nth int, entry string")
    best = hits.groupBy("url").agg(F.min_by("entry", "nth").alias("entry"))
    return join_side(pages, best, "url", "left", 200).select("page_id", "url", "entry", F.col("entry").isNotNull().alias("blocked"))


def query_list(spark: SparkSession) -> DataFrame:
    """The block list of the query."""
    number = spark.range(NUMBERS // 3).withColumn("host", F.explode(F.array(*map(F.lit, HOSTS)))).withColumn("lang", F.explode(F.array(*map(F.lit, LANGUAGES))))
    page = lambda plus: F.concat("host", F.lit("/"), "lang", F.lit("/"), (F.col("id") * 3 + plus).cast("string"))
    more = spark.range(DOMAINS_MORE).select(F.concat(F.lit("g"), "id", F.lit(".listed.example")).alias("entry"))
    known = spark.createDataFrame([(d,) for d in DOMAINS], "entry string")
    return known.unionByName(number.select(page(0).alias("entry"))).unionByName(number.select(F.concat(page(1), F.lit("?page=2&ref=x")).alias("entry"))).unionByName(more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check(table(spark, sf_dir, "pages"), query_list(spark))


_QUOTED = lambda names: ", ".join(f"'{n}'" for n in names)
SQL = f"""
WITH page_of AS (SELECT h || '/' || l || '/' AS base, i FROM (SELECT unnest([{_QUOTED(HOSTS)}]) AS h), (SELECT unnest([{_QUOTED(LANGUAGES)}]) AS l), range({NUMBERS // 3}) AS r(i)),
listed AS (SELECT unnest([{_QUOTED(DOMAINS)}]) AS entry UNION ALL SELECT base || (3 * i) FROM page_of
           UNION ALL SELECT base || (3 * i + 1) || '?page=2&ref=x' FROM page_of UNION ALL SELECT 'g' || i || '.listed.example' FROM range({DOMAINS_MORE}) AS r(i)),
cut AS (SELECT row_number() OVER () AS r, page_id, url, lower(rtrim(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//)?([^/?#@]*@)?([^/?#:]+)', 4), '.')) AS h,
        rtrim(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+([^?#]*)', 2), '/') AS p, string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&') AS qs FROM pages),
part AS (SELECT *, array_to_string([x for x in qs if x <> '' AND NOT starts_with(x, 'utm_')], '&') AS q, string_split(p, '/') AS ps, string_split(h, '.') AS hs FROM cut WHERE h <> ''),
tried AS (SELECT r, h || p || '?' || q AS entry FROM part WHERE q <> ''
          UNION SELECT r, h || array_to_string(ps[1:k], '/') FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM part)
          UNION SELECT r, array_to_string(hs[k:], '.') FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS k FROM part)),
best AS (SELECT r, arg_max(entry, length(entry)) AS entry FROM tried JOIN listed USING (entry) GROUP BY r)
SELECT page_id, url, entry, entry IS NOT NULL AS blocked FROM cut LEFT JOIN best USING (r)
"""
