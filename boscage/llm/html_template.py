"""HTML extraction by template deduction from equivalence classes of tokens.

The tokens of a page are its tags and words. A token is told apart by the tags it
lies in, a word by the token before it as well. Its occurrence vector has how
often each page of the host has it; tokens with the same vector form a class.
Classes that are large (``LEAST_SIZE`` tokens) and frequent (``SUPPORT`` of the
host's pages, ``LEAST_PAGES`` at least) are checked:

- ordered: on every page the class's tokens come in one and the same order,
  over and over; of a class that isn't, its tags alone may still be;
- nested: between any two classes, all occurrences of one lie in the same gap of
  the other (or all outside it). Classes are taken by the number of their
  occurrences, the page frame first, and one that doesn't nest is left out.

The classes taken are the host's template. What remains on a page between
template tokens are its slots, each named by the class and place of the token
before it.

Vectors aren't gathered: a token's is held as four sums of random numbers of its
pages, which add up over any split of a host, so one huge host is no task of its own.
Only tokens that are frequent in some part of the pages are counted (a token that is
frequent in all pages of a host is so in a part of them), which loses none.

Defined cases: a null page has null text and slots, an empty one empty slots;
pages without a host, and hosts of under ``LEAST_PAGES`` pages, have no template
and keep all their words; equal pages count each; scripts, styles and comments
aren't text; unclosed and stray tags are taken as they come; a page is read whole
at any length and depth; ties between classes go to the smaller class number,
which is a hash of its vector; an empty table gives no rows; further
columns may have any name.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pandas.util import hash_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_batch, checkpoint, join_side, pick, slices, stored, table

#: Share of a host's pages and number of pages that a class is on at least (so a host may have several layouts), and its tokens.
SUPPORT, LEAST_PAGES, LEAST_SIZE = 0.2, 3, 3
#: Tokens that a worker gathers before it looks which are frequent.
GATHERED = 4 << 20
#: The token that every page has once.
PAGE = 0
SCHEMA = "page_id long, host string, template_tokens int, roles array<string>, slots array<string>, text string"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
#: Tags that end an open one of the given names.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), **{t: ("p",) for t in _BLOCK - {"br", "li", "dt", "dd", "tr", "td", "th", "html", "head", "body", "title", "tbody", "thead", "tfoot"}}}
#: An open tag of these hides what is open outside it from the tags that end one.
_WALLS = frozenset("ul ol dl table select article section body html".split())
_SKIP = re.compile(r"<!--(?:.*?-->|.*\Z)|<(script|style)\b[^>]*>(?:.*?</\1\s*>|.*\Z)|<[!?][^>]*>?", re.S | re.I)
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_LINES = re.compile(r" *\n[ \n]*")
_QUOTED = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*'|["'])*""")
_BALANCED = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*""")
_HOST = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str | None:
    found = _HOST.match(url) if url else None
    return found[1].lower() if found else None


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1


class _Known(dict):
    """Results of a function, remembered up to a number of them."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, x):
        if len(self) > 500_000:
            self.clear()
        self[x] = found = self.function(x)
        return found


def _tag(head: str) -> tuple | None:
    """Of what stands between angle brackets: name, whether it ends one, whether it stays open, what it ends, its text and hash.

    None if it's no tag, and no name if a quote is open, so that it goes on.
    """
    m = _NAME.match(head)
    if not m:
        return None
    if head.count('"') % 2 or head.count("'") % 2:
        return None, False, False, None, "", 0
    end, name = bool(m[1]), m[2].lower()
    return name, end, not (end or name in _VOID or head.endswith("/")), None if end else _ENDS.get(name), "\n" if name in _BLOCK else "", _hash(("</" if end else "<") + name)


_tag_of = _Known(_tag)
_path_of = _Known(lambda x: _hash(f"{x[0]}/{x[1]}"))
_place, _before, _self = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _whole_tag(part: str, parts: list[str], at: int) -> tuple[str, int]:
    """A tag with those of ``parts`` (from ``at``) that an opening bracket within its quotes has cut off, and where the next begins.

    A quote that isn't closed before a blank, a slash or the tag's end is a stray one.
    """
    while True:
        rest = part[_BALANCED.match(part).end() :]
        if rest[:1] not in ('"', "'"):
            return part, at
        to = at
        while to < len(parts) and rest[0] not in parts[to]:
            to += 1
        if to == len(parts) or parts[to].partition(rest[0])[2][:1] not in tuple(" \t\r\n\f/>"):
            return part, at
        part, at = "<".join([part, *parts[at : to + 1]]), to + 1


def _word_hashes(words: np.ndarray) -> np.ndarray:
    """A keyed hash of each word, the same in every worker."""
    try:
        return hash_array(words, categorize=False)
    except UnicodeEncodeError:  # half a pair of surrogates
        return hash_array(np.array([w.encode("utf-16", "surrogatepass").decode("latin-1") for w in words], object), categorize=False)


def tokens_of(pages: list[str]) -> tuple[np.ndarray, list[int], list[str]]:
    """The tokens of many pages: their keys, the page's own first, where each page begins, and their texts.

    A text is empty for a tag, and a line end for one that ends a line.
    """
    texts: list[str] = []
    own: list[int] = []  # hashes of the tags by themselves
    runs: list[int] = []  # of each run of tokens: path, number, 0 for tags
    offsets = [0]
    tag_of, path_of = _tag_of.__getitem__, _path_of.__getitem__
    for page in pages:
        texts.append("")
        own.append(0)
        runs += (1, 1, 0)
        open_names: list[str] = []
        paths = [1]
        opened: dict[str, int] = defaultdict(int)
        parts = _SKIP.sub("", page).split("<")
        at_part, n_parts = 0, len(parts)
        while at_part < n_parts:
            part = parts[at_part]
            at_part += 1
            if at_part == 1:
                text = part
            else:
                head, _, text = part.partition(">")
                tag = tag_of(head)
                if tag is not None and tag[0] is None:  # a bracket in quotes, or a stray quote
                    part, at_part = _whole_tag(part, parts, at_part)
                    head = _QUOTED.match(part)[0]
                    text = part[len(head) + 1 :]
                    tag = tag_of(_NAME.match(head)[0] + "/" * head.endswith("/"))
                if tag is None:
                    text = "<" + part
                else:
                    name, end, stays, ended, line, itself = tag
                    if end:
                        if not opened[name]:
                            itself = 0
                        while itself:
                            last = open_names.pop()
                            paths.pop()
                            opened[last] -= 1
                            if last == name:
                                break
                    elif ended:
                        for e in ended:
                            if opened[e]:
                                at = len(open_names) - 1
                                while at >= 0 and open_names[at] not in ended and open_names[at] not in _WALLS:
                                    at -= 1
                                if at >= 0 and open_names[at] in ended:
                                    for gone in open_names[at:]:
                                        opened[gone] -= 1
                                    del open_names[at:], paths[at + 1 :]
                                break
                    if itself:
                        own.append(itself)
                        texts.append(line)
                        runs += (paths[-1], 1, 0)
                        if stays:
                            open_names.append(name)
                            opened[name] += 1
                            paths.append(path_of((paths[-1], name)))
            if text:
                words = (html.unescape(text) if "&" in text else text).split()
                if words:
                    texts += words
                    runs += (paths[-1], len(words), 1)
        offsets.append(len(texts))
    path, count, kind = np.array(runs, np.int64).reshape(-1, 3).T
    tag = np.repeat(kind == 0, count)
    itself = np.empty(len(texts), np.uint64)
    itself[tag] = own
    itself[~tag] = _word_hashes(np.array(texts, object)[~tag]) >> np.uint64(1)
    before = np.zeros(len(itself), np.uint64)
    before[1:] = itself[:-1]
    before[tag] = 0
    x = np.repeat(path.astype(np.uint64), count) * _place + before * _before + itself * _self
    x = (x ^ x >> np.uint64(32)) * _before
    x = ((x ^ x >> np.uint64(29)) * _place) >> np.uint64(1)
    keys = np.where(tag, x & ~np.uint64(1) | np.uint64(2), x | np.uint64(1)).astype(np.int64)
    keys[np.array(offsets[:-1], np.int64)] = PAGE
    return keys, offsets, texts


def tokens(page: str) -> tuple[np.ndarray, list[str]]:
    keys, _, texts = tokens_of([page])
    return keys, texts


def is_word(key: int) -> bool:
    return bool(key & 1)


def _tokenised(batches) -> Iterator[tuple[str, str, bytes | None, np.ndarray]]:
    """Host, page, plan if there is one, and keys of each page."""
    for batch in batches:
        for part in slices(batch, "html"):
            pages = part.column("html").to_pylist()
            plans = part.column("plan").to_pylist() if "plan" in part.schema.names else [None] * len(pages)
            keys, offsets, _ = tokens_of(pages)
            for k, (host, page, plan) in enumerate(zip(part.column("host").to_pylist(), pages, plans)):
                yield host, page, plan, keys[offsets[k] : offsets[k + 1]]


def _found(batches) -> Iterator[tuple[str, bytes, np.ndarray]]:
    """Host, plan and candidate tokens of each page."""
    for batch in batches:
        for host, plan, raw in zip(*(batch.column(n).to_pylist() for n in ("host", "plan", "keys"))):
            yield host, plan, np.frombuffer(raw, np.int64)


def _frequent(pages: DataFrame) -> DataFrame:
    """(host, keys): the tokens that are frequent in some part of the host's pages, as bytes of int64."""

    def run(batches):
        schema = pa.schema([("host", pa.string()), ("keys", pa.list_(pa.int64()))])
        held: dict[str, list[np.ndarray]] = defaultdict(list)

        def send():
            hosts, found = [], []
            for host, pages_of in held.items():
                keys, count = np.unique(np.concatenate(pages_of), return_counts=True)
                hosts.append(host)
                found.append(keys[count >= SUPPORT * len(pages_of)])
            return as_batch([hosts, found], schema)

        n = 0
        for host, _, _, keys in _tokenised(batches):
            held[host].append(np.unique(keys))
            n += len(held[host][-1])
            if n > GATHERED:
                yield send()
                held.clear()
                n = 0
        if n:
            yield send()

    found = pages.mapInArrow(run, "host string, keys array<long>")
    return found.select("host", F.explode("keys").alias("key")).distinct().groupBy("host").agg(F.collect_list("key").alias("keys"))


@functools.lru_cache(maxsize=256)
def _known(keys: bytes) -> np.ndarray:
    return np.sort(np.frombuffer(keys, np.int64))


def _as_bytes(df: DataFrame, column: str) -> DataFrame:
    """Arrays of long as the bytes of int64, which pages carry along at little cost."""

    def run(batches):
        schema = pa.schema([("host", pa.string()), ("plan", pa.binary())])
        for batch in batches:
            yield as_batch([batch.column("host"), [np.array(k, np.int64).tobytes() for k in batch.column(column).to_pylist()]], schema)

    return df.select("host", column).mapInArrow(run, "host string, plan binary")


def _hits(pages: DataFrame) -> DataFrame:
    """(host, own, keys) for each page: a hash of it, and its tokens that are candidates, in order.

    These are few of a page's tokens. They are written, so vectors, orders and nesting take no further look at the pages.
    """

    def run(batches):
        schema = pa.schema([("host", pa.string()), ("own", pa.binary()), ("keys", pa.binary())])
        for batch in batches:
            rows = []
            for host, page, plan, keys in _tokenised([batch]):
                known = _known(plan)
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                rows.append((host, xxhash.xxh3_128_digest(f"{host}\0{page}".encode("utf-8", "surrogatepass")), keys[known[at] == keys].tobytes()))
            if rows:
                yield as_batch(list(zip(*rows)), schema)

    return stored(pages.mapInArrow(run, "host string, own binary, keys binary"), "html-hits")


def _counted(hits: DataFrame) -> DataFrame:
    """(host, key, s0..s3, pages, total): the vector of every candidate token."""

    def run(batches):
        names = ["host", "key", "s0", "s1", "s2", "s3", "pages", "total"]
        schema = pa.schema([("host", pa.string())] + [(n, pa.int64()) for n in names[1:]])
        for batch in batches:
            held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
            for host, own, raw in zip(*(batch.column(n).to_pylist() for n in ("host", "own", "keys"))):
                keys, count = np.unique(np.frombuffer(raw, np.int64), return_counts=True)
                number = int.from_bytes(own, "little")
                parts = [count * (number >> 32 * k & (1 << 26) - 1) for k in range(4)]
                held[host].append((keys, np.stack([*parts, np.ones(len(keys), np.int64), count], axis=1)))
            for host, found in held.items():
                keys = np.concatenate([k for k, _ in found])
                by = np.argsort(keys, kind="stable")
                keys, starts = np.unique(keys[by], return_index=True)
                sums = np.add.reduceat(np.concatenate([v for _, v in found])[by], starts, axis=0)
                yield as_batch([[host] * len(keys), keys, *sums.T], schema)

    part = hits.mapInArrow(run, "host string, key long, s0 long, s1 long, s2 long, s3 long, pages long, total long")
    return part.groupBy("host", "key").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "s2", "s3", "pages", "total")])


def _classes(counted: DataFrame) -> DataFrame:
    """(host, class, keys, total): large and frequent classes of tokens with the same vector."""
    vector = ["s0", "s1", "s2", "s3", "pages", "total"]
    all_pages = counted.where(F.col("key") == PAGE).select("host", F.col("pages").alias("all_pages"))
    often = counted.join(all_pages, "host").where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= SUPPORT * F.col("all_pages")))
    return often.groupBy("host", *vector).agg(F.sort_array(F.collect_list("key")).alias("keys")).where(F.size("keys") >= LEAST_SIZE).select("host", F.xxhash64(*vector).alias("class"), "keys", "total")


class Plan:
    """The classes of one host: numbered by rank, their tokens in order."""

    def __init__(self, classes: list[tuple[int, list[int]]]):
        self.ids = [c for c, _ in classes]
        self.size = [len(keys) for _, keys in classes]
        rows = sorted((key, k, place) for k, (_, keys) in enumerate(classes) for place, key in enumerate(keys))
        self.keys, self.of, self.place = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((), (), ())))
        self.tags = Counter(k for key, k, _ in rows if not is_word(key))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``keys`` are template tokens, and which."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.asarray(keys)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        return hit, at[hit]

    @staticmethod
    def pack(classes: list[tuple[int, list[int]]]) -> bytes:
        return np.array([x for c, keys in classes for x in (c, len(keys), *keys)], np.int64).tobytes()

    @staticmethod
    @functools.lru_cache(maxsize=256)
    def load(packed: bytes) -> Plan:
        flat, out, at = np.frombuffer(packed, np.int64).tolist(), [], 0
        while at < len(flat):
            n = flat[at + 1]
            out.append((flat[at], flat[at + 2 : at + 2 + n]))
            at += 2 + n
        return Plan(out)


def order_of(found: list[int], size: int) -> tuple[int, ...] | None:
    """The order in which ``found`` has the tokens of a class of this size, over and over; None if it doesn't."""
    first = tuple(found[:size])
    if len(found) % size or len(set(first)) != size or found != list(first) * (len(found) // size):
        return None
    return first


def page_orders(plan: Plan, keys: np.ndarray) -> list[tuple[int, bool, tuple[int, ...] | None]]:
    """For each class on a page, whole and by its tags alone: class, whether by tags, its order."""
    found: dict[int, list[int]] = defaultdict(list)
    which = plan.find(keys)[1]
    for k, key in zip(plan.of[which].tolist(), plan.keys[which].tolist()):
        found[k].append(key)
    out = []
    for k, own in found.items():
        out.append((plan.ids[k], False, order_of(own, plan.size[k])))
        if LEAST_SIZE <= plan.tags[k] < plan.size[k]:
            out.append((plan.ids[k], True, order_of([x for x in own if not is_word(x)], plan.tags[k])))
    return out


def page_nesting(plan: Plan, keys: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """For two classes (by rank), the least and the last gap of the first where occurrences of the second lie; (-1, 1) if one lies across a token of the first.

    Gap 0 is outside, k that after the k-th token of an occurrence.
    """
    which = plan.find(keys)[1]
    sequence = zip(plan.of[which].tolist(), plan.place[which].tolist())
    n = len(plan.ids)
    gap = [0] * n
    began: list[list[int] | None] = [None] * n
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for k, place in sequence:
        if place == 0:
            began[k] = gap.copy()
        gap[k] = (place + 1) % plan.size[k]
        if place == plan.size[k] - 1:
            for a in range(k):
                lo = hi = began[k][a] if began[k] else -1
                if gap[a] != lo:
                    lo, hi = -1, 1
                was = out.get((a, k), (lo, hi))
                out[a, k] = min(was[0], lo), max(was[1], hi)
        for b in range(k + 1, n):  # a token of k within an occurrence of b
            if began[b] is not None and gap[b]:
                out[k, b] = (-1, 1)
    return out


def nest(classes: list[tuple[int, list[int]]], gaps: dict[tuple[int, int], tuple[int, int]]) -> list[tuple[int, list[int]]]:
    """The classes, by rank, that nest in all that were taken before them."""
    taken: list[tuple[int, list[int]]] = []
    for c, keys in classes:
        if all((g := gaps.get((t, c))) is None or g[0] == g[1] for t, _ in taken):
            taken.append((c, keys))
    return taken


def _ranked(classes: list[tuple[int, list[int], int]]) -> list[tuple[int, list[int]]]:
    return [(c, keys) for c, keys, total in sorted(classes, key=lambda x: (x[2], x[0]))]


_NO_PLAN = Plan([])


def fill(plan: Plan, keys: np.ndarray, texts: list[str]) -> tuple[int, list[str], list[str], str]:
    """Of a page's tokens: number of template tokens; roles and texts of the slots; the text."""
    roles, slots, role, known = [], [], "", 0
    where, which = plan.find(keys)
    names = zip(plan.of[which].tolist(), plan.place[which].tolist())
    begin = 0
    for at, name in [*zip(where.tolist(), names), (len(texts), None)]:
        text = " ".join(filter(None, texts[begin:at])) if begin < at else ""
        if "\n" in text:
            text = _LINES.sub("\n", text).strip()
        if text:
            roles.append(role)
            slots.append(text)
        if name:
            known += bool(keys[at] != PAGE)
            role = f"{name[0]}:{name[1]}"
        begin = at + 1
    return known, roles, slots, "\n".join(slots)


def extract(pages: DataFrame) -> DataFrame:
    """One row for each page: host, its template tokens, its slots with their roles, and its text."""
    pages = pick(pages, page_id="long", url="string", html="string")
    pages = pages.withColumn("host", F.lower(F.nullif(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))))
    known = pages.where("host is not null and html is not null").select("host", "html")
    with_plan: Callable[[DataFrame, DataFrame], DataFrame] = lambda p, plan: join_side(p, plan, "host", "inner", 4096)
    hits = _hits(with_plan(known, _as_bytes(_frequent(known), "keys")))
    classes = checkpoint(_classes(_counted(hits)))

    def packed(group: pa.Table) -> pa.Table:
        rows = _ranked(list(zip(group.column("class").to_pylist(), group.column("keys").to_pylist(), group.column("total").to_pylist())))
        return pa.table({"host": pa.array([group.column("host")[0].as_py()], pa.string()), "plan": pa.array([Plan.pack(rows)], pa.binary())})

    def orders(batches):
        schema = pa.schema([("host", pa.string()), ("class", pa.int64()), ("tags", pa.bool_()), ("one", pa.int64()), ("other", pa.int64()), ("ordered", pa.bool_()), ("keys", pa.list_(pa.int64()))])
        held: dict[tuple, list] = {}
        for host, plan, keys in _found(batches):
            for c, tags, order in page_orders(Plan.load(plan), keys):
                own = _hash(repr(order)) if order else 0
                was = held.setdefault((host, c, tags), [own, own, True, order or ()])
                was[0], was[1], was[2] = min(was[0], own), max(was[1], own), was[2] and order is not None
        if held:
            yield as_batch([*zip(*held), *zip(*held.values())], schema)

    def gaps(batches):
        schema = pa.schema([("host", pa.string()), ("outer", pa.int64()), ("inner", pa.int64()), ("least", pa.int32()), ("most", pa.int32())])
        held: dict[tuple, tuple[int, int]] = {}
        for host, packed_plan, keys in _found(batches):
            plan = Plan.load(packed_plan)
            for (a, b), (lo, hi) in page_nesting(plan, keys).items():
                was = held.get((host, plan.ids[a], plan.ids[b]), (lo, hi))
                held[host, plan.ids[a], plan.ids[b]] = min(was[0], lo), max(was[1], hi)
        if held:
            yield as_batch([*zip(*held), *zip(*held.values())], schema)

    def nested(own: pa.Table, seen: pa.Table) -> pa.Table:
        rows = _ranked(list(zip(own.column("class").to_pylist(), own.column("keys").to_pylist(), own.column("total").to_pylist())))
        found = {(a, b): (lo, hi) for a, b, lo, hi in zip(*(seen.column(n).to_pylist() for n in ("outer", "inner", "least", "most")))}
        if not rows:
            return pa.table({"host": pa.array([], pa.string()), "plan": pa.array([], pa.binary())})
        return pa.table({"host": pa.array([own.column("host")[0].as_py()], pa.string()), "plan": pa.array([Plan.pack(nest(rows, found))], pa.binary())})

    def slots(batches):
        schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("template_tokens", pa.int32()), ("roles", pa.list_(pa.string())), ("slots", pa.list_(pa.string())), ("text", pa.string())])
        for batch in batches:
            for part in slices(batch, "html"):
                pages, plans = part.column("html").to_pylist(), part.column("plan").to_pylist()
                keys, offsets, texts = tokens_of([p or "" for p in pages])
                rows = [(None,) * 4 if page is None else fill(Plan.load(plan) if plan else _NO_PLAN, keys[a:b], texts[a:b]) for page, plan, a, b in zip(pages, plans, offsets, offsets[1:])]
                yield as_batch([part.column("page_id"), part.column("host"), *zip(*rows)], schema)

    plan_schema = "host string, plan binary"
    checked = with_plan(hits, classes.groupBy("host").applyInArrow(packed, plan_schema)).mapInArrow(orders, "host string, class long, tags boolean, one long, other long, ordered boolean, keys array<long>")
    checked = checked.groupBy("host", "class", "tags").agg(F.min("one").alias("one"), F.max("other").alias("other"), F.min("ordered").alias("ordered"), F.min("keys").alias("keys")).where("ordered and one = other")
    # a class by its tags alone only counts where the whole isn't ordered
    checked = checked.groupBy("host", "class").agg(F.min_by("keys", "tags").alias("keys"))
    ordered = checkpoint(checked.join(classes.select("host", "class", "total"), ["host", "class"]))
    seen = with_plan(hits, ordered.groupBy("host").applyInArrow(packed, plan_schema)).mapInArrow(gaps, "host string, outer long, inner long, least int, most int")
    seen = seen.groupBy("host", "outer", "inner").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    template = ordered.groupBy("host").cogroup(seen.groupBy("host")).applyInArrow(nested, plan_schema)
    return join_side(pages, template, "host", "left", 4096).select("page_id", "host", "html", "plan").mapInArrow(slots, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
