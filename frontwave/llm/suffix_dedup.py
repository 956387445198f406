"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes when a ``length``-byte string that covers it also starts anywhere else. Texts are UTF-8 bytes, matches never
cross documents.

1. Every window of ``length`` bytes has an anchor: the leftmost of its ``gram``-byte strings with the least hash. The
   anchor is a function of the window's bytes, so equal windows have equal anchors at equal places, and the suffixes of
   all documents can be dealt by their window's anchor, without any pair being missed. Consecutive windows share an
   anchor; such a run is one record: the anchor's hash, a 128-bit digest of the bytes its windows cover (the context), and
   place. What a task meets of a context beyond two records is known to repeat there, and is dealt anywhere.
2. Records are dealt by anchor and streamed. Equal contexts met twice: all their windows repeat. An anchor with one
   record: none does. An anchor with different contexts is open: one record of each context goes on.
3. The bytes of open contexts are fetched, by a scan that a Bloom filter of fixed size keeps to the rows in question.
4. An anchor with more than ``hot`` open contexts is dealt further (``split``): its windows are halved by their place relative
   to the anchor, and dealt by the bytes that all windows of a half have in common, again and again until at most ``hot``
   different strings are left together. Equal strings are collapsed, byte by byte, and strings that are alone drop out, so
   the rows made follow the differences.
5. Per group, the windows' suffixes are sorted by a mergesort that works on all groups of a batch at once: two suffixes
   are compared by the longest common extension, found by binary search over prefix polynomial hashes (mod 2**64, read at
   any place through powers of the base and its inverse), so a comparison takes a logarithmic number of steps. Neighbours in order with a
   common extension of the full length repeat; that is verified byte by byte, so a hash collision removes nothing.
6. Removed runs are the union of repeated windows; the kept bytes' digest is made where a document has any.

Rows are known by a hash of id and text: repeated rows are separate documents that repeat each other in full, and share
their intervals. Defined results: a null text counts as empty; a text shorter than ``length`` keeps all; an empty table
gives an empty table; null ids are like any other; extra columns are not carried. Whole texts are read, however long: a
long text is worked on in segments that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import bounded, drop_scratch, written

U = np.uint64
BASE = U(0x9E3779B97F4A7C55)
#: The base's inverse modulo 2**64.
INVERSE = U(pow(int(BASE), -1, 2**64))
_PLACE = 24


@dataclass(frozen=True)
class DedupSettings:
    length: int = 200
    gram: int = 64
    hot: int = 1024
    segment: int = 1 << 19
    bloom_bits: int = 25


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, BASE), np.full(size, INVERSE)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the prefixes of a byte array: p[j] - p[i] is the hash of data[i:j] times base**i."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys."""
    n = len(keys)
    padded = np.concatenate([keys, np.full(-n % width, np.iinfo(U).max, U)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(data: np.ndarray, ends: np.ndarray, settings: DedupSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, last window) of each run of windows with one anchor. ``ends`` are the texts' ends in ``data``."""
    none = (np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64))
    length, gram = settings.length, settings.gram
    if len(data) < length:
        return none
    p = prefix_hashes(data)
    n = len(data) - gram + 1
    h = _mix((p[gram:] - p[:n]) * _powers(len(data) + 1)[1][:n])
    least = _window_min((h & ~U((1 << _PLACE) - 1)) | np.arange(n, dtype=U), length - gram + 1)
    place = (least & U((1 << _PLACE) - 1)).astype(np.int64)
    at = np.arange(len(place))
    valid = at + length <= ends[np.searchsorted(ends, at, side="right")]
    fresh = np.concatenate([[True], (place[1:] != place[:-1]) | ~valid[:-1]])
    starts = np.flatnonzero(fresh & valid)
    if not len(starts):
        return none
    stops = np.concatenate([np.flatnonzero(np.concatenate([(fresh[1:] | ~valid[1:]), [True]]) & valid)])
    return h[place[starts]], starts, stops


def _segments(texts: list[bytes], settings: DedupSettings) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Bounded pieces of a batch: bytes, ends, and (text number, offset in the text) of each part."""
    data, ends, whose, size = [], [], [], 0
    for i, t in enumerate(texts):
        if len(t) < settings.length:
            continue
        for off in range(0, max(1, len(t) - settings.length + 1), settings.segment):
            part = t[off : off + settings.segment + settings.length - 1]
            data.append(part)
            size += len(part)
            ends.append(size)
            whose.append((i, off))
            if size >= settings.segment:
                yield np.frombuffer(b"".join(data), np.uint8), np.array(ends), whose
                data, ends, whose, size = [], [], [], 0
    if data:
        yield np.frombuffer(b"".join(data), np.uint8), np.array(ends), whose


def _binary(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def records(docs: DataFrame, settings: DedupSettings, most: int = 1_000_000) -> DataFrame:
    """h, c, d, row, a, b, again: each run's anchor hash, context digest (two numbers), row, first and last window, and whether this task gave two records of the context before."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        for batch in bounded(batches, 1):
            rows, texts = batch.column(0).to_numpy(), _binary(batch.column(1))
            for data, ends, whose in _segments(texts, settings):
                h, starts, stops = anchor_runs(data, ends, settings)
                if not len(h):
                    continue
                view, length, digest = memoryview(data), settings.length, hashlib.blake2b
                c = np.frombuffer(b"".join([digest(view[s : e + length], digest_size=16).digest() for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                if len(met) > most:
                    met.clear()
                again = []
                for key in c[:, 0].tolist():
                    n = met.get(key, 0)
                    met[key] = n + 1
                    again.append(n >= 2)
                part = np.searchsorted(ends, starts, side="right")
                text = np.array([w[0] for w in whose])[part]
                shift = np.array([w[1] for w in whose])[part] - np.concatenate([[0], ends])[part]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(rows[text]), pa.array((starts + shift).astype(np.int32)), pa.array((stops + shift).astype(np.int32)), pa.array(again)], ["h", "c", "d", "row", "a", "b", "again"])

    return docs.select("row", "text").mapInArrow(over, "h long, c long, d long, row long, a int, b int, again boolean")


def classify(found: DataFrame, most: int = 200_000) -> DataFrame:
    """row, a, b, h, kind: 0 all windows repeat; 1 open, met once; 2 open, a representative of windows that repeat.

    An anchor's records come sorted by context. Those of the last anchor of a batch are held back, unless they are many:
    then its finished contexts are let go, and what is known of the anchor is kept.
    """

    def out(row, a, b, h, kind) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip((row, a, b, h, kind), (np.int64, np.int32, np.int32, np.int64, np.int32), strict=True)], ["row", "a", "b", "h", "kind"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        # the anchor whose records were partly let go, its last context let go, whether it has several contexts, its first record if not yet sent
        known: tuple[int, tuple[int, int], bool, tuple | None] | None = None

        def settle(h, c, d, row, a, b, final: bool):
            """Rows for all records, or for all but those of the last context; how many were settled."""
            nonlocal known
            fresh_h = np.concatenate([[True], h[1:] != h[:-1]])
            fresh = fresh_h | np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
            starts = np.flatnonzero(fresh)
            count = np.diff(np.concatenate([starts, [len(h)]]))
            n = len(h) if final else int(starts[-1])
            if n == 0 and not final:  # one context of very many records: they repeat
                n = len(h)
            group = np.cumsum(fresh_h) - 1
            kinds = np.bincount(group[starts], minlength=group[-1] + 1)
            goes_on = known is not None and known[0] == h[0]
            same = goes_on and known[1] == (c[0], d[0])
            early = []
            if goes_on:
                kinds[0] += 1
                if same:
                    kinds[0] -= 1
                    count[0] += 1
                if known[2]:
                    kinds[0] = max(kinds[0], 2)
                if kinds[0] > 1 and known[3] is not None:
                    early.append(known[3])
            many, several = np.repeat(count > 1, np.diff(np.concatenate([starts, [len(h)]]))), kinds[group] > 1
            kind = np.where(many, 0, np.where(several, 1, -1))
            rep = np.zeros(len(h), bool)
            rep[starts] = True
            if same:
                rep[0] = False  # sent before, or just now
            take, reps = np.flatnonzero((kind >= 0)[:n]), np.flatnonzero((rep & many & several)[:n])
            at = np.concatenate([take, reps])
            label = np.concatenate([kind[take], np.full(len(reps), 2)])
            if final:
                known = None
            else:
                last = group[n - 1]
                lone = kinds[last] == 1
                first = int(starts[0])
                pending = (known[3] if goes_on and known[3] is not None else (int(row[first]), int(a[first]), int(b[first]), int(h[first]), 2)) if lone else None
                known = (int(h[n - 1]), (int(c[n - 1]), int(d[n - 1])), not lone, pending)
            cols = [np.concatenate([x[at].astype(np.int64), np.array([e[i] for e in early], np.int64)]) for i, x in ((0, row), (1, a), (2, b), (3, h))]
            return out(*cols, np.concatenate([label, np.full(len(early), 2)])), n

        for batch in batches:
            again = batch.column(6).to_numpy(zero_copy_only=False)
            own = [batch.column(i).to_numpy() for i in range(6)]
            if again.any():
                h, _, _, row, a, b = (x[again] for x in own)
                yield out(row, a, b, h, np.zeros(len(h)))
                own = [x[~again] for x in own]
            own = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            h = own[0]
            if not len(h):
                continue
            last = int(np.searchsorted(h != h[-1], False)) if h[0] == h[-1] else len(h) - int(np.argmax(h[::-1] != h[-1]))
            if last:
                some, _ = settle(*(x[:last] for x in own), True)
                if some.num_rows:
                    yield some
            held = [x[last:] for x in own]
            if len(held[0]) > most:
                some, n = settle(*held, False)
                yield some
                held = [x[n:] for x in held] if n < len(held[0]) else None
        if held is not None and len(held[0]):
            some, _ = settle(*held, True)
            if some.num_rows:
                yield some

    anywhere = F.when(F.col("again"), F.pmod(F.xxhash64("row", "a"), F.lit(1 << 20))).otherwise(F.lit(0))
    return found.withColumn("_deal", anywhere).repartition("h", "_deal").sortWithinPartitions("h", "c", "d").drop("_deal").mapInArrow(over, "row long, a int, b int, h long, kind int")


# ---- suffix sort


def common(p: np.ndarray, inverse: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """The common extension of each pair of places, at most ``length``: binary search on the hashes of equally long strings."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), length, np.int64)
    px, py, ix, iy = p[x], p[y], inverse[x], inverse[y]
    for _ in range(length.bit_length()):
        mid = (low + high + 1) >> 1
        same = (p[x + mid] - px) * ix == (p[y + mid] - py) * iy
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_order(data: np.ndarray, p: np.ndarray, places: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """The order of suffixes by group, then by their first ``length`` bytes: a bottom-up mergesort over all groups at once.

    ``group`` is rising. In each pass every element finds its rank in the sibling run of its group by binary search.
    """
    n = len(places)
    order, inverse = np.arange(n), _powers(len(data) + 1)[1]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    first = np.repeat(starts, np.diff(np.concatenate([starts, [n]])))
    end = first + np.repeat(np.diff(np.concatenate([starts, [n]])), np.diff(np.concatenate([starts, [n]])))
    largest = int((end - first).max()) if n else 0
    width = 1
    while width < largest:
        at = np.arange(n)
        run = (at - first) // width
        left = run % 2 == 0
        low = first + np.where(left, run + 1, run - 1) * width
        high = np.minimum(low + width, end)
        low = np.minimum(low, end)
        begin, own_start = low.copy(), first + run * width
        active = np.flatnonzero(low < high)
        while len(active):
            mid = (low[active] + high[active]) >> 1
            x, y = places[order[at[active]]], places[order[mid]]
            ext = common(p, inverse, x, y, length)
            full = ext >= length
            bx, by = data[np.where(full, x, x + ext)], data[np.where(full, y, y + ext)]
            # an element of the left run goes before its equals of the right run
            after = np.where(full, ~left[active], by < bx)
            low[active] = np.where(after, mid + 1, low[active])
            high[active] = np.where(after, high[active], mid)
            active = active[low[active] < high[active]]
        target = np.where(left, at, own_start - width + (at - own_start)) + (low - begin)
        new = np.empty(n, np.int64)
        new[target] = order
        order, width = new, width * 2
    return order


def repeated(contexts: list[bytes], group: np.ndarray, settings: DedupSettings) -> list[np.ndarray]:
    """For each context, which of its windows also occur elsewhere among the contexts of its group (given in rising order).

    Equal windows have their anchor at the same place, so the suffixes of a group are sorted apart by that place.
    """
    length, grams = settings.length, settings.length - settings.gram + 1
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    windows = sizes - length + 1
    within = np.arange(windows.sum()) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    places = np.repeat(begins, windows) + within
    p = prefix_hashes(data)
    n = len(data) - settings.gram + 1
    keys = _mix((p[settings.gram :] - p[:n]) * _powers(len(data) + 1)[1][:n]) & ~U((1 << _PLACE) - 1)
    anchors = np.concatenate([keys[begins[lo : lo + 4096, None] + np.arange(grams)].argmin(axis=1) for lo in range(0, len(begins), 4096)])
    bucket = np.repeat(group, windows) * (2 * grams) + np.repeat(anchors, windows) - within + grams
    by_place = np.argsort(bucket, kind="stable")
    places, groups = places[by_place], bucket[by_place]
    order = suffix_order(data, p, places, groups, length)
    x, y = places[order[:-1]], places[order[1:]]
    same = groups[order[:-1]] == groups[order[1:]]
    pairs = np.flatnonzero(same)
    pairs = pairs[common(p, _powers(len(data) + 1)[1], x[pairs], y[pairs], length) >= length]
    span, twice = np.arange(length), np.zeros(len(places), bool)
    for lo in range(0, len(pairs), 20_000):  # verification, byte by byte
        part = pairs[lo : lo + 20_000]
        part = part[(data[x[part][:, None] + span] == data[y[part][:, None] + span]).all(axis=1)]
        twice[order[part]] = True
        twice[order[part + 1]] = True
    flags = np.empty(len(twice), bool)
    flags[by_place] = twice
    return np.split(flags, np.cumsum(windows)[:-1])


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def contexts(docs: DataFrame, wanted: DataFrame, settings: DedupSettings) -> DataFrame:
    """The open records with their bytes. Only the texts of rows that the filter lets through are shuffled."""
    bits = settings.bloom_bits
    shared = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted, "row", bits))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.may_hold(shared.value, batch.column(0).to_numpy(), bits)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            h, row, a, b, kind, data = [], [], [], [], [], []
            for r, text, runs in zip(batch.column(0).to_pylist(), _binary(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for x in runs:
                    row.append(r)
                    h.append(x["h"])
                    a.append(x["a"])
                    b.append(x["b"])
                    kind.append(x["kind"])
                    data.append(text[x["a"] : x["b"] + settings.length])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(row, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["h", "row", "a", "b", "kind", "data"])

    runs = wanted.groupBy("row").agg(F.collect_set(F.struct("h", "a", "b", "kind")).alias("runs"))
    texts = docs.select("row", "text").mapInArrow(pick, "row long, text string").dropDuplicates(["row"])
    return texts.join(runs, "row").select("row", "text", "runs").mapInArrow(cut, "h long, row long, a int, b int, kind int, data binary")


def resolve(opened: DataFrame, settings: DedupSettings) -> DataFrame:
    """row, a, b of the repeated windows of open records, by the suffix sort of each group ``h``."""
    most = 1 << 18

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def sort(rows: list[tuple]) -> pa.RecordBatch:
            ids = np.cumsum(np.concatenate([[0], [x[0] != y[0] for x, y in zip(rows, rows[1:], strict=False)]])).astype(np.int64)
            out = [(r[1], r[2] + s, r[2] + e) for r, flags in zip(rows, repeated([r[5] for r in rows], ids, settings), strict=True) if r[4] == 1 for s, e in _spans(flags)]
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], ["row", "a", "b"])

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if size >= most and held[-1][0] != r[0]:
                    yield sort(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield sort(held)

    return opened.repartition("h").sortWithinPartitions("h").mapInArrow(over, "row long, a int, b int")


def split(opened: DataFrame, settings: DedupSettings) -> DataFrame:
    """The rows of hot groups, halved: windows whose anchor is at ``low`` to ``high`` bytes from their start are cut in the middle, and each half is dealt by the bytes that all its windows have in common.

    Of windows that are equal, the anchor is at the same place and the common bytes are the same, so they stay together.
    """
    length, gram = settings.length, settings.gram

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 5):
            out: list[tuple] = []
            held = [x or b"" for x in batch.column(5).to_pylist()]
            every = np.frombuffer(b"".join(held), np.uint8)
            p = prefix_hashes(every)
            n = len(every) - gram + 1
            keys = _mix((p[gram:] - p[:n]) * _powers(len(every) + 1)[1][:n]) & ~U((1 << _PLACE) - 1)
            begins = np.cumsum([0, *map(len, held)])[:-1]
            anchors = keys[begins[:, None] + np.arange(length - gram + 1)].argmin(axis=1)
            for (row, a, b, kind, low, high), data, anchor in zip(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4, 6, 7)), strict=True), held, anchors.tolist(), strict=True):
                middle = (low + high) // 2
                for lo, hi in ((low, middle), (middle + 1, high)):
                    # window i has its anchor at anchor - i
                    first, last = max(0, anchor - hi), min(b - a, anchor - lo)
                    if lo <= hi and first <= last:
                        core = hashlib.blake2b(data[anchor - lo : anchor - hi + length] + bytes([lo % 256, hi % 256]), digest_size=8).digest()
                        out.append((int.from_bytes(core, "little", signed=True), row, a + first, a + last, kind, data[first : last + length], lo, hi))
            columns = list(zip(*out, strict=True)) or [()] * 8
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["h", "row", "a", "b", "kind", "data", "low", "high"])

    return opened.select("h", "row", "a", "b", "kind", "data", "low", "high").mapInArrow(over, "h long, row long, a int, b int, kind int, data binary, low int, high int")


def _sorted_groups(rows: DataFrame, settings: DedupSettings) -> list[DataFrame]:
    """The repeated windows of open contexts, in parts: each group of at most ``hot`` contexts is sorted, others are halved first."""
    found = []
    rows = rows.withColumns({"low": F.lit(0), "high": F.lit(settings.length - settings.gram)})
    while True:
        hot = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > settings.hot).select("h"), "hot")
        if hot.isEmpty():
            return [*found, written(resolve(rows.select("h", "row", "a", "b", "kind", "data"), settings), "repeats")]
        found.append(written(resolve(rows.join(hot, "h", "left_anti").select("h", "row", "a", "b", "kind", "data"), settings), "repeats"))
        halves = written(split(rows.join(hot, "h", "left_semi"), settings), "halves")
        same = written(halves.groupBy("h", "data", "low", "high").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "a", "b", "kind")).alias("one")), "halves")
        found.append(halves.where("kind = 1").join(same.where("n > 1").select("h", "data"), ["h", "data"], "left_semi").select("row", "a", "b"))
        several = same.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
        rows = same.join(several, "h", "left_semi").select("h", "one.row", "one.a", "one.b", F.when(F.col("n") > 1, 2).otherwise(F.col("one.kind")).alias("kind"), "data", "low", "high")


def repeated_runs(docs: DataFrame, settings: DedupSettings) -> DataFrame:
    """row, a, b: the first and last window of runs of repeated windows; docs have row and text."""
    kinds = written(classify(records(docs, settings)), "runs")
    opened = kinds.where("kind > 0")
    runs = kinds.where("kind = 0").select("row", "a", "b")
    if opened.isEmpty():
        return runs
    rows = written(contexts(docs, opened.select("h", "row", "a", "b", "kind"), settings), "contexts")
    for part in _sorted_groups(rows, settings):
        runs = runs.unionByName(part)
    drop_scratch(docs.sparkSession, rows)
    return runs


def strip_repeats(docs: DataFrame, settings: DedupSettings = DedupSettings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of every document."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    runs = repeated_runs(own, settings)
    shared = spark.sparkContext.broadcast(bloom.build(runs, "row", settings.bloom_bits))
    bits, length = settings.bloom_bits, settings.length
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def stripped(data: bytes, spans: list) -> tuple[int, int, bytes]:
        if not spans:
            return 0, 0, data
        at = np.zeros(len(data) + 1, np.int64)
        np.add.at(at, [s["a"] for s in spans], 1)
        np.add.at(at, [s["b"] + length for s in spans], -1)
        gone = np.cumsum(at)[:-1] > 0
        return int(gone.sum()), int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])), np.frombuffer(data, np.uint8)[~gone].tobytes()

    def made(ids: pa.Array, texts: list[bytes], spans: list[list]) -> pa.RecordBatch:
        got = [stripped(t, s or []) for t, s in zip(texts, spans, strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string()), pa.array([g[2] for g in got], pa.binary())], names)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            batch = batch.filter(pa.array(~bloom.may_hold(shared.value, batch.column(0).to_numpy(), bits)))
            if batch.num_rows:
                yield made(batch.column(1), _binary(batch.column(2)), [[]] * batch.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.may_hold(shared.value, batch.column(0).to_numpy(), bits)))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            yield made(batch.column(0), _binary(batch.column(1)), batch.column(2).to_pylist())

    rows = own.select("row", "doc_id", "text")
    spans = runs.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    hit = rows.mapInArrow(touched, f"row long, doc_id {kind}, text string").join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(applied, schema)
    return rows.mapInArrow(untouched, schema).unionByName(hit)


def report(docs: DataFrame) -> DataFrame:
    return strip_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
