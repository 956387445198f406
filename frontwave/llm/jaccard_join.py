"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

1. ``profiles``: a document's words become a set of 64-bit n-gram hashes. Grams are put in one global order, rare ones
   first: by their count where they are frequent, then by hash. Counts come from all documents; a bounded table of the most
   frequent grams is all that ordering needs (a gram outside it is rare), and any order gives the same result.
2. Documents of equal sets are one node, so exact copies are never paired; a task hands on a node's prefix once.
3. Each node's prefix (the grams of which every similar set must share one, and of large sets up to eight) is joined by gram,
   for the grams that more than one node has, which are found by an aggregation that combines before the shuffle. Within a
   gram's list, sorted by set size, pairs must pass the length and positional filters. The pairs of a short list (at most
   ``short`` nodes) are counted over all lists; those that share as many grams as their sizes ask for come to the suffix
   filter: the hash space is cut into ranges and the sets' counts in them are compared, whose difference bounds the symmetric
   difference from below.
4. In longer lists all three filters act within the list, and what leaves it is not its pairs but a forest that spans them,
   so that the rows made grow with the lists and not with their squares. In a list of more than ``window`` nodes, each
   meets only the last ``window`` before it, under looser filters. Lists whose nodes are then in more than one group are
   looked at again: every node outside the list's largest group meets all nodes of other groups, in blocks, under the
   strict filters (``cross_edges``). So two nodes that may be similar are in one group, whatever the length of their lists:
   either they share a gram of a longer list, or all grams that they must share are in short ones.
5. Each pair of a group is verified once, by whole sets, in blocks (``block_links``); a block gives the number of links of
   each node and a forest that spans its links. Pairs never leave a block: copies are not expanded into pairs, yet the
   numbers of links are exact.
6. Components of the links, by star rounds.

Hash collisions: sets are compared by 64-bit hashes of grams, equal sets are known by a 64-bit digest of these.

Defined results: a null or empty text, or one without words, has the empty set, 0 grams, and is linked with nothing; with
fewer words than a gram needs, the whole sequence is the one gram; very long texts are read whole, one at a time; repeated
rows and equal texts are one node; rows with a null id take part, and a component whose ids are all null has a null id; an
empty table gives an empty table; extra columns are not carried. A hot gram, set or component is never in one task as a
whole: equal sets meet in aggregations with map-side minima, a long list is dealt to as many tasks as its length needs, a
component to as many as its blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import bounded, drop_scratch, release, table_of_texts, written
from .components import components, forest

U = np.uint64
_LONG_WORD = 4096


@dataclass(frozen=True)
class JoinSettings:
    """Two sets link when ``den * intersection >= num * union``. ``heavy`` bounds the table of frequent grams; lists of at most ``short`` nodes give pairs, those of more than ``window`` + 1 are dealt in parts of about ``part`` nodes; the Bloom filter has ``2**bloom_bits`` bits."""

    words: int = 5
    num: int = 80
    den: int = 100
    heavy: int = 262_144
    heavy_least: int = 8
    short: int = 48
    window: int = 48
    looser: int = 10
    part: int = 65_536
    bloom_bits: int = 25

    def overlap(self, n, looser: int = 0):
        """Least intersection of two linked sets whose sizes sum to ``n``."""
        num = self.num - looser
        return -(-num * n // (num + self.den))

    def extra(self, n):
        """How many grams beyond the first a prefix must share."""
        return np.minimum(n // 128, 7)

    def prefix(self, n):
        return n - -(-self.num * n // self.den) + 1 + self.extra(n)


# ---- sets


_COEFFICIENTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of texts that lie end to end, with A-Z folded, and the place of each text's first word among them (and of the end). Words are read eight bytes at a time."""
    n = len(data)
    gap = np.ones(n + 1, bool)
    gap[:n] = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[True], gap[:n]]) | edge
    begin = np.flatnonzero(~gap & before)
    stop = np.flatnonzero(~gap[:n] & (gap[1:] | edge[1:])) + 1
    folded = np.zeros(n + 8, np.uint8)
    folded[:n] = _FOLD[data]
    eight = np.ndarray((n + 1,), "<u8", folded, 0, (1,))
    length = stop - begin
    h = _mix((eight[begin] & _MASK[np.minimum(length, 8)]) + length.astype(U) * _COEFFICIENTS[0])
    more, at = np.flatnonzero((length > 8) & (length <= _LONG_WORD)), 8
    while len(more):
        h[more] = _mix(h[more] * _COEFFICIENTS[1] ^ eight[begin[more] + at] & _MASK[np.minimum(length[more] - at, 8)])
        at += 8
        more = more[length[more] > at]
    for i in np.flatnonzero(length > _LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(folded[begin[i] : stop[i]])
    return h, np.searchsorted(begin, bounds)


def gram_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, sorted, end to end, and where each text's begin (and the end)."""
    h, first = word_hashes(data, bounds)
    words = np.diff(first)
    short = np.flatnonzero((words > 0) & (words < size))
    made = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    flat, whole = np.empty(at[-1], U), np.ones(at[-1], bool)
    whole[at[short]] = False
    last = len(h) - size + 1
    weights = _COEFFICIENTS[np.arange(size) % 8] * (2 * (np.arange(size) // 8) + 1).astype(U)
    if last > 0:
        text = np.repeat(np.arange(len(words)), words)
        total = h[:last] * weights[0]
        for i in range(1, size):
            total += h[i : i + last] * weights[i]
        flat[whole] = _mix(total[text[:last] == text[size - 1 :]] + U(size))
    for t in short.tolist():
        n = int(words[t])
        flat[at[t]] = _mix((h[first[t] : first[t] + n] * weights[:n]).sum(keepdims=True, dtype=U) + U(n))[0]
    ends = at.tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        if b - a > 1:
            flat[a:b].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[at[:-1][made > 0]] = True
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def gram_set(text: str | None, size: int) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return gram_sets(data, np.array([0, len(data)]), size)[0]


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams, digest_size=16).digest()


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _row_key(doc_id, digest: bytes) -> int:
    """A row's number: rows of one id and one set are one."""
    return xxhash.xxh3_64_intdigest(repr(doc_id).encode() + digest) >> 1


def _ranges(grams: np.ndarray) -> bytes:
    """How many grams are in each of 16 to 4096 equal ranges of the hash space, two to four of them a range where that is enough, 255 at most."""
    bits = min(12, max(4, (len(grams) // 4).bit_length()))
    return np.minimum(np.bincount((grams >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def frequent_grams(docs: DataFrame, settings: JoinSettings) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams, at most ``heavy``, sorted by hash, and their counts.

    A task counts with bounded memory: of more than ``4 * heavy`` counters, those of the least counts go. Counts of
    grams that are frequent enough to matter are lower bounds, which is all an order needs.
    """
    most, size = settings.heavy, settings.words

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.empty(0, U), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []
        held = 0

        def fold() -> None:
            nonlocal grams, counts, held
            every = np.sort(np.concatenate(waiting))
            waiting.clear()
            held = 0
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
            c = np.diff(np.concatenate([starts, [len(every)]]))
            known = np.isin(every[starts], grams, assume_unique=True) | (c > 1)
            every, back = np.unique(np.concatenate([grams, every[starts][known]]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, c[known]]), len(every)).astype(np.int64)
            grams = every
            if len(grams) > 4 * most:
                top = np.argpartition(-counts, 4 * most)[: 4 * most]
                top.sort()
                grams, counts = grams[top], counts[top]

        for part in bounded(batches, 0):
            waiting.append(gram_sets(*table_of_texts(part.column(0)), size)[0])
            held += len(waiting[-1])
            if held > 2_000_000:
                fold()
        if waiting:
            fold()
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts)], ["gram", "n"])

    sums = docs.mapInArrow(over, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.heavy_least)
    top = sums.orderBy(F.col("n").desc(), "gram").limit(most).toArrow()
    grams, counts = top["gram"].to_numpy().view(U), top["n"].to_numpy()
    order = np.argsort(grams)
    return grams[order], counts[order]


def profiles(docs: DataFrame, settings: JoinSettings) -> DataFrame:
    """doc_id, row, node, n, ranges, prefix of every document; the last two are null where the task gave them for the same set before."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(frequent_grams(docs.select("text"), settings))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, counts = shared.value
        seldom = np.ones(1 << 22, bool)
        seldom[heavy >> U(42)] = False
        seen: set[int] = set()
        for part in bounded(batches, 1):
            grams, at = gram_sets(*table_of_texts(part.column(1)), settings.words)
            weight = np.zeros(len(grams), np.int64)
            if len(heavy) and len(grams):
                maybe = np.flatnonzero(~seldom[grams >> U(42)])
                place = np.minimum(np.searchsorted(heavy, grams[maybe]), len(heavy) - 1)
                weight[maybe] = np.where(heavy[place] == grams[maybe], counts[place], 0)
            row, node, ranges, prefix = [], [], [], []
            for doc_id, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own, w = grams[a:b], weight[a:b]
                d = _digest(own)
                row.append(_row_key(doc_id, d))
                node.append(_node(d))
                if a == b or node[-1] in seen:
                    ranges.append(None)
                    prefix.append(None)
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(node[-1])
                ranges.append(_ranges(own))
                prefix.append((own[np.argsort(w, kind="stable")] if w.any() else own)[: settings.prefix(b - a)].view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(row, pa.int64()), pa.array(node, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(ranges, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "row", "node", "n", "ranges", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = written(docs.select("doc_id", "text").mapInArrow(over, f"doc_id {kind}, row long, node long, n long, ranges binary, prefix array<long>"), "profiles")
    shared.destroy()
    return out


# ---- candidates


class Ranges:
    """The range counts of some nodes, end to end."""

    def __init__(self, rows: list[bytes]):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(rows), np.uint8)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A lower bound of each pair's symmetric difference; the finer of two divisions is folded to the other's."""
        out = np.zeros(len(i), np.int64)
        kinds = self.size[i] * 8192 + self.size[j]
        for kind in np.unique(kinds).tolist():
            x, y = divmod(kind, 8192)
            own, z = np.flatnonzero(kinds == kind), min(x, y)
            for lo in range(0, len(own), max(1, (1 << 21) // max(x, y))):
                k = own[lo : lo + max(1, (1 << 21) // max(x, y))]
                a, b = (self.data[self.at[e[k], None] + np.arange(w)] for e, w in ((i, x), (j, y)))
                a, b = (v.reshape(len(k), z, -1).sum(axis=2, dtype=np.int32) if v.shape[1] > z else v.astype(np.int32) for v in (a, b))
                out[k] = np.abs(a - b).sum(axis=1)
        return out


def _may_link(n, pos, i, j, settings: JoinSettings, looser: int = 0) -> np.ndarray:
    """Which pairs pass the length and positional filters: before a shared gram there are at most as many others as the smaller prefix has beyond the first."""
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    left = np.minimum(n[i] - pos[i], n[j] - pos[j]) + settings.extra(small)
    return (small * settings.den >= large * (settings.num - looser)) & (left >= settings.overlap(small + large, looser))


def _passes(n, pos, ranges: Ranges, i, j, settings: JoinSettings, looser: int = 0) -> np.ndarray:
    """Which pairs pass the length, positional and suffix filters."""
    least = settings.overlap(n[i] + n[j], looser)
    fits = _may_link(n, pos, i, j, settings, looser)
    at = np.flatnonzero(fits)
    fits[at] = ranges.apart(i[at], j[at]) <= n[i[at]] + n[j[at]] - 2 * least[at]
    return fits


def shared_lists(every: DataFrame) -> DataFrame:
    """gram, node, n, pos, c: the postings of the grams that more than one node has in its prefix; c is their number."""
    postings = every.where("prefix is not null").select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
    counts = postings.groupBy("gram").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo <> hi").select("gram", "c")
    return written(postings.join(counts, "gram").select("gram", "node", "n", "pos", "c"), "lists")


def _ranges_of(every: DataFrame, nodes: DataFrame) -> DataFrame:
    return every.where("prefix is not null").join(nodes.distinct(), "node", "left_semi").select("node", "ranges").dropDuplicates(["node"])


def short_pairs(lists: DataFrame, every: DataFrame, settings: JoinSettings) -> DataFrame:
    """(a, b): the pairs of short lists that pass the filters and share as many grams as they must."""
    short = settings.short

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            own = own if held is None else pa.concat_tables([held, own])
            gram, n, node, pos = (own.column(i).to_numpy() for i in range(4))
            last = int(np.searchsorted(gram != gram[-1], False)) if gram[0] == gram[-1] else len(gram) - int(np.argmax(gram[::-1] != gram[-1]))
            yield pairs(gram[:last], n[:last], node[:last], pos[:last])
            held = own.slice(last)
        if held is not None:
            yield pairs(*(held.column(i).to_numpy() for i in range(4)))
        release()

    def pairs(gram, n, node, pos) -> pa.RecordBatch:
        # a node may be posted once by each task that has one of its copies
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        gram, n, node, pos = (x[fresh] for x in (gram, n, node, pos))
        first, found = np.arange(len(gram)), []
        for step in range(1, short):
            first = first[first + step < len(gram)]
            first = first[gram[first + step] == gram[first]]
            if not len(first):
                break
            i = first[_may_link(n, pos, first, first + step, settings)]
            found.append((np.minimum(node[i], node[i + step]), np.maximum(node[i], node[i + step]), 1 + settings.extra(np.minimum(n[i], n[i + step]))))
        a, b, need = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(b[starts]), pa.array(need[starts]), pa.array(np.diff(np.concatenate([starts, [len(a)]])))], ["a", "b", "need", "k"])

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 3):
            n = np.concatenate([batch.column(i).to_numpy() for i in (2, 4)])
            ranges = Ranges([*batch.column(3).to_pylist(), *batch.column(5).to_pylist()])
            i = np.arange(batch.num_rows)
            yield batch.select([0, 1]).filter(pa.array(_passes(n, np.zeros_like(n), ranges, i, i + batch.num_rows, settings)))

    few = lists.where(F.col("c") <= short).select("gram", "n", "node", "pos")
    met = few.repartition("gram").sortWithinPartitions("gram", "n", "node").mapInArrow(over, "a long, b long, need long, k long")
    pairs_ = written(met.groupBy("a", "b").agg(F.sum("k").alias("k"), F.max("need").alias("need")).where("k >= need").select("a", "b"), "candidates")
    ranges = _ranges_of(every, pairs_.select(F.explode(F.array("a", "b")).alias("node")))
    sizes = every.where("prefix is not null").select("node", "n")
    side = lambda c: ranges.join(sizes.dropDuplicates(["node"]), "node").select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("ranges").alias(f"r_{c}"))
    return pairs_.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "r_a", "n_b", "r_b").mapInArrow(suffix, "a long, b long")


def near_edges(lists: DataFrame, settings: JoinSettings) -> DataFrame:
    """(a, b): a forest that spans the pairs that pass the filters in the longer lists: up to ``window`` + 1 nodes all, of others those within a window, under looser filters."""
    window = settings.window

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                own = pa.Table.from_batches([batch.slice(lo, 8192)])
                own = own if held is None else pa.concat_tables([held, own])
                gram, part, n, node, pos, c = (own.column(i).to_numpy() for i in range(6))
                ranges = Ranges(own.column(6).to_pylist())
                group = np.cumsum(np.concatenate([[False], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])]))
                first, found = np.arange(len(gram)), []
                for step in range(1, window + 1):
                    first = first[first + step < len(gram)]
                    first = first[group[first + step] == group[first]]
                    if not len(first):
                        break
                    i, j = first[node[first] != node[first + step]], first[node[first] != node[first + step]] + step
                    for some, looser in ((c[i] <= window + 1, 0), (c[i] > window + 1, settings.looser)):
                        k = np.flatnonzero(some)
                        k = k[_passes(n, pos, ranges, i[k], j[k], settings, looser)]
                        found.append((node[i[k]], node[j[k]]))
                a, b = forest(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.empty(0, np.int64),) * 2
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                held = own.slice(max(int(np.searchsorted(group, group[-1])), len(gram) - window))
        release()

    dealt = lists.select("gram", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / settings.part)).alias("part"), "n", "node", "pos", "c", "ranges")
    return dealt.repartition("gram", "part").sortWithinPartitions("gram", "part", "n", "node").mapInArrow(over, "a long, b long")


def cross_edges(long: DataFrame, labels: DataFrame, settings: JoinSettings, side: int = 4096) -> DataFrame | None:
    """(a, b): a forest that spans the groups of which two nodes pass the filters in some long list; None where each list is of one group.

    Nodes outside their list's largest group meet those of other groups, by bands of size, in blocks of about ``side`` by ``side``.
    """
    step = F.log(F.lit(settings.den / settings.num))
    named = long.join(labels, "node", "left").select("gram", "n", "node", "pos", "ranges", F.coalesce("label", "node").alias("label"), F.floor(F.log("n") / step).cast("long").alias("band"))
    sizes = named.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("c"))
    largest = written(sizes.groupBy("gram").agg(F.max_by("label", F.struct("c", "label")).alias("largest"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("gram", "largest"), "mixed")
    if largest.isEmpty():
        return None
    columns = ["n", "pos", "label", "ranges"]
    own = written(named.join(largest, "gram").select("gram", "band", "node", *columns, "largest"), "mixed")
    rest = own.where("label <> largest").select("gram", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "node", *columns)
    number = lambda df, name: df.groupBy("gram", "band").agg(F.ceil(F.count(F.lit(1)) / side).alias(name))
    blocks = number(own, "of_all").join(number(rest, "of_rest"), ["gram", "band"])
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    inner = own.join(blocks, ["gram", "band"]).select("gram", "band", dealt("of_all").alias("x"), spread("of_rest").alias("y"), F.lit(False).alias("outer"), *columns)
    outer = rest.join(blocks, ["gram", "band"]).select("gram", "band", spread("of_all").alias("x"), dealt("of_rest").alias("y"), F.lit(True).alias("outer"), *columns)

    def met(rows: list[tuple]) -> pa.RecordBatch:
        n, pos, label = (np.array([r[i] for r in rows], np.int64) for i in (5, 6, 7))
        ranges, out = Ranges([r[8] for r in rows]), np.array([r[4] for r in rows], bool)
        every, found = np.flatnonzero(~out), set()
        for i in np.flatnonzero(out).tolist():
            at = every[label[every] != label[i]]
            at = at[_passes(n, pos, ranges, np.full(len(at), i), at, settings)]
            found |= {(int(label[i]), k) for k in np.unique(label[at]).tolist()}
        a, b = forest(*np.array(sorted(found), np.int64).reshape(-1, 2).T)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    spread_out = inner.unionByName(outer).repartition("gram", "band", "x", "y").sortWithinPartitions("gram", "band", "x", "y")
    return spread_out.mapInArrow(_by_group(4, met), "a long, b long")


def _by_group(keys: int, made, different: int = 0):
    """A function for ``mapInArrow`` over rows sorted by their first ``keys`` columns: ``made`` of the rows of each group; of rows that follow each other with the same ``different`` first columns, one."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                for r in zip(*(some.column(i).to_pylist() for i in range(some.num_columns)), strict=True):
                    if held and held[-1][:keys] != r[:keys]:
                        yield made(held)
                        held = []
                    elif held and different and held[-1][:different] == r[:different]:
                        continue
                    held.append(r)
        if held:
            yield made(held)
        held = []
        release()

    return over


def groups(every: DataFrame, settings: JoinSettings) -> DataFrame:
    """(node, label) of the nodes that are a candidate with another; two nodes that may be similar have one label."""
    spark = every.sparkSession
    lists = shared_lists(every)
    edges = short_pairs(lists, every, settings)
    longer = lists.where(F.col("c") > settings.short).dropDuplicates(["gram", "node"])
    if longer.isEmpty():
        labels, more = components(edges), None
    else:
        longer = written(longer.join(_ranges_of(every, longer.select("node")), "node").select("gram", "node", "n", "pos", "c", "ranges"), "longer")
        labels = components(edges.unionByName(near_edges(longer, settings)))
        long = longer.where(F.col("c") > settings.window + 1)
        more = None if long.isEmpty() else cross_edges(long, labels, settings)
    if more is not None:
        moved = components(more)
        with_new = labels.unionByName(moved.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti"))
        step = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = written(with_new.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    drop_scratch(spark, lists)
    return labels


# ---- verification


def sets_of(docs: DataFrame, nodes: DataFrame, settings: JoinSettings) -> DataFrame:
    """node, grams: the whole sets of the nodes in question, made again from the texts; a set may come once from each task.

    The scan passes over all others by a Bloom filter of fixed size (a set let through by mistake finds no group).
    """
    bits, size = settings.bloom_bits, settings.words
    shared = docs.sparkSession.sparkContext.broadcast(bloom.build(nodes, "node", bits))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in bounded(batches, 0):
            grams, at = gram_sets(*table_of_texts(part.column(0)), size)
            ends = at.tolist()
            keys = np.array([_node(_digest(grams[a:b])) for a, b in zip(ends, ends[1:], strict=False)], np.int64)
            keep = [i for i in np.flatnonzero(bloom.may_hold(shared.value, keys, bits)).tolist() if ends[i] < ends[i + 1] and not (keys[i] in seen or seen.add(keys[i]))]
            if len(seen) >= 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep], pa.int64()), pa.array([grams[ends[i] : ends[i + 1]].tobytes() for i in keep], pa.binary())], ["node", "grams"])

    return docs.select("text").mapInArrow(over, "node long, grams binary")


def tile_links(left: list[np.ndarray], right: list[np.ndarray], settings: JoinSettings, columns: int = 1024, pairs: int = 500_000) -> np.ndarray:
    """Which of the left sets link with which of the right ones. Grams of many rows are counted by matrix products, the others pair by pair."""
    nl, nr = (np.array([len(g) for g in side], np.int64) for side in (left, right))
    gl, gr = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(gl, gr)
    both = np.zeros((len(nl), len(nr)), np.float32)  # exact up to 2**24 grams
    if len(shared):
        ends = []
        for grams, n in ((gl, nl), (gr, nr)):
            at = np.minimum(np.searchsorted(shared, grams), len(shared) - 1)
            hit = shared[at] == grams
            row, at = np.repeat(np.arange(len(n)), n)[hit], at[hit]
            order = np.argsort(at, kind="stable")
            ends.append((row[order], np.bincount(at, minlength=len(shared))))
        (rl, dl), (rr, dr) = ends
        el, er = np.cumsum(dl), np.cumsum(dr)
        many = dl * dr * 128 > both.size
        heavy, light = np.flatnonzero(many), np.flatnonzero(~many)
        for k in range(0, len(heavy), columns):
            part = heavy[k : k + columns]
            a, b = np.zeros((len(nl), len(part)), np.float32), np.zeros((len(nr), len(part)), np.float32)
            for c, v in enumerate(part.tolist()):
                a[rl[el[v] - dl[v] : el[v]], c] = 1
                b[rr[er[v] - dr[v] : er[v]], c] = 1
            both += a @ b.T
        work = np.cumsum(dl[light] * dr[light])
        first = 0
        while first < len(light):
            end = max(first + 1, int(np.searchsorted(work, (work[first - 1] if first else 0) + pairs, side="right")))
            v = light[first:end]
            n = dl[v] * dr[v]
            gram = np.repeat(np.arange(len(v)), n)
            place = np.arange(len(gram)) - np.repeat(np.cumsum(n) - n, n)
            i, j = rl[(el - dl)[v][gram] + place // dr[v][gram]], rr[(er - dr)[v][gram] + place % dr[v][gram]]
            both += np.bincount(i * len(nr) + j, minlength=both.size).reshape(both.shape).astype(np.float32)
            first = end
    both = both.astype(np.int64)
    return settings.den * both >= settings.num * (nl[:, None] + nr[None, :] - both)


def _few_links(left: list[np.ndarray], right: list[np.ndarray], settings: JoinSettings) -> np.ndarray:
    """:func:`tile_links` for a handful of sets."""
    both = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.int64)
    return settings.den * both >= settings.num * (np.array([len(a) for a in left])[:, None] + np.array([len(b) for b in right])[None, :] - both)


def _spanning(hit: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of links that span all links of a tile: breadth first, so that few of them are looked at twice."""
    if len(hit) <= 16:
        return np.nonzero(np.triu(hit, 1) if same else hit)
    rows, columns, unseen = [], [], [np.ones(hit.shape[0], bool), np.ones(hit.shape[1], bool)]
    sides = (hit, hit.T)
    for start in range(hit.shape[0]):
        if not unseen[0][start]:
            continue
        unseen[0][start] = False
        waiting = [(0, start)]
        while waiting:
            side, at = waiting.pop()
            other = side if same else 1 - side
            new = np.flatnonzero(sides[side][at] & unseen[other])
            unseen[other][new] = False
            waiting += [(other, k) for k in new.tolist()]
            own = np.full(len(new), at)
            rows.append(new if side else own)
            columns.append(own if side else new)
    return np.concatenate(rows), np.concatenate(columns)


def block_links(made: DataFrame, members: DataFrame, settings: JoinSettings, side: int = 4096, most: int = 500_000, tile: int = 1024) -> DataFrame:
    """a, b, links: with how many nodes of its group each node a links (b is null), and links (a, b) that span all of the block (links is null). ``members`` has node, label, n.

    A group is cut into parts of about ``side`` nodes and at most about ``most`` grams; each two parts meet in one block,
    and a block is worked off in tiles. So each pair of a group is verified once. ``made`` may hold a set more than once.
    """
    num, den = settings.num, settings.den
    cut = members.groupBy("label").agg(F.ceil(F.greatest(F.count(F.lit(1)) / side, F.sum("n") / most)).cast("long").alias("parts"), F.count(F.lit(1)).alias("c")).where("c > 1")
    dealt = members.join(cut, "label").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = met.select("label", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "node").join(made, "node").select("label", "x", "y", "part", "node", "grams")

    def tiles(held: list[tuple]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        held = sorted(((r[4], np.frombuffer(r[5], U)) for r in held), key=lambda r: (len(r[1]), r[0]))
        return [(np.array([r for r, _ in held[i : i + tile]], np.int64), [g for _, g in held[i : i + tile]]) for i in range(0, len(held), tile)]

    def block(held: list[tuple]) -> pa.RecordBatch:
        _, x, y = held[0][:3]
        left = tiles([r for r in held if r[3] == x])
        right = left if x == y else tiles([r for r in held if r[3] == y])
        nodes, counts, spans = [], [], []
        for i, (a, own) in enumerate(left):
            for b, others in right[i:] if x == y else right:
                if len(own[-1]) * den < num * len(others[0]) or len(others[-1]) * den < num * len(own[0]):
                    continue
                hit = (_few_links if len(own) * len(others) <= 64 else tile_links)(own, others, settings)
                if a is b:
                    np.fill_diagonal(hit, False)
                else:
                    nodes.append(b)
                    counts.append(hit.sum(axis=0))
                nodes.append(a)
                counts.append(hit.sum(axis=1))
                r, c = _spanning(hit, a is b)
                spans.append((a[r], b[c]))
        a, b = forest(*(np.concatenate(s) for s in zip(*spans, strict=True))) if spans else (np.empty(0, np.int64),) * 2
        each, back = np.unique(np.concatenate(nodes), return_inverse=True) if nodes else (np.empty(0, np.int64), np.empty(0, np.int64))
        total = np.bincount(back, np.concatenate(counts), len(each)).astype(np.int64) if nodes else back
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([each, a])), pa.concat_arrays([none(len(each)), pa.array(b)]), pa.concat_arrays([pa.array(total), none(len(a))])], ["a", "b", "links"])

    spread = rows.repartition("label", "x", "y").sortWithinPartitions("label", "x", "y", "part", "node")
    return written(spread.mapInArrow(_by_group(3, block, 5), "a long, b long, links long"), "found")


def similar_classes(docs: DataFrame, settings: JoinSettings = JoinSettings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row, n_shingles, component_id (the least id of the component), label (a component's number), n_links (the number of other sets that the document's set links with)."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    every = profiles(docs, settings)
    members = groups(every, settings)
    sizes = every.where("prefix is not null").select("node", "n").join(members, "node").groupBy("node", "label").agg(F.max("n").alias("n"))
    found = block_links(sets_of(docs, members, settings), written(sizes, "members"), settings)
    labels = components(found.where("b is not null").select("a", "b"))
    degree = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    placed = every.select("doc_id", "row", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = placed.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("label", "least")
    whole = placed.join(degree, "node", "left").join(least, "label", "left")
    return whole.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "label", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


#: The query's contract: shingles of three words, similarity of 90 hundredths.
CONTRACT = JoinSettings(words=3, num=90, den=100)


def report(docs: DataFrame) -> DataFrame:
    return similar_classes(docs, CONTRACT).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: one document of each class of similar texts stays (five words, 0.8), that of the least id.

    It is chosen by row, not by id: null ids come last, of equal ids the row of the least number stays, and of repeated rows
    the one of the least text. Texts without words are similar to nothing and all stay. Only documents that a Bloom filter
    of fixed size takes for a row that goes or is repeated are shuffled; the others are never among them.
    """
    settings = JoinSettings()
    found = written(similar_classes(docs, settings).select("doc_id", "row", "n_shingles", "label"), "classes")
    stays = found.where("n_shingles > 0").groupBy("label").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("_row"), F.count(F.lit(1)).alias("c"))
    classes = found.where("n_shingles > 0").join(stays.where("c > 1").select("label", "_row"), "label")
    marked = written(classes.groupBy("row").agg(F.max(F.col("row") == F.col("_row")).alias("_stays"), F.count(F.lit(1)).alias("c")).where("c > 1 or not _stays").select(F.col("row").alias("_row"), "_stays"), "marked")
    size, bits, names = settings.words, settings.bloom_bits, docs.columns
    at, text = names.index("doc_id"), names.index("text")
    shared = spark.sparkContext.broadcast(bloom.build(marked, "_row", bits))

    def rows(asked: bool):
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in bounded(batches, text):
                grams, ends = gram_sets(*table_of_texts(part.column(text)), size)
                keys = np.array([_row_key(i, _digest(grams[a:b])) for i, a, b in zip(part.column(at).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.int64)
                keep = bloom.may_hold(shared.value, keys, bits) == asked
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(keys)] * asked], [*names, *["_row"] * asked]).filter(pa.array(keep))

        return over

    plain = docs.mapInArrow(rows(False), docs.schema)
    some = docs.mapInArrow(rows(True), T.StructType([*docs.schema.fields, T.StructField("_row", T.LongType())])).join(marked, "_row", "left").where("_stays is null or _stays")
    twice = some.where("_stays").groupBy("_row").agg(F.min_by(F.struct(*names), "text").alias("_doc")).select("_doc.*")
    return plain.unionByName(some.where("_stays is null").select(*names)).unionByName(twice)
