"""Secret scans: fixed patterns, plus sliding-window Shannon entropy over candidate strings.

Base patterns give spans of kind ``assign``, ``access`` and ``hex``. The method adds ``entropy`` spans: candidate
strings (long runs of key characters) are sorted into character classes; a window slides over the string, its symbol
counts are updated by one step in and one step out, and the sum of ``c*log2(c)`` with them, so each step costs O(1).
Windows at or over the class's threshold are merged into spans. Strings on the allow-list, and spans that lie inside a
base span, are suppressed. Base spans are never suppressed.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows are each scanned; extra columns
pass through :func:`scan` untouched; an empty table gives an empty table. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded

# The base patterns of the contract, in the order that breaks ties.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{32}")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32


@dataclass(frozen=True)
class EntropyRule:
    """``window`` characters at ``bits`` or more of entropy; ``member`` says which candidates belong to the class."""

    name: str
    member: str
    window: int
    bits: float


#: The first class whose pattern matches the whole candidate is used.
RULES = (
    EntropyRule("hex", r"(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+", 24, 3.1),
    EntropyRule("alnum", r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z]+|(?=.*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z])[0-9A-Za-z]+", 20, 3.7),
    EntropyRule("base64", r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/_=-]+", 20, 3.9),
)
#: Candidates that match are not secrets: UUIDs, dates and versions, placeholders, paths and hyphenated words, content digests.
ALLOWED = (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    r"[0-9_=+/-]+",
    r"(?i).*(?:example|placeholder|changeme|dummy|xxxx).*",
    r"(?:[A-Za-z]+[/_-])*[A-Za-z]+=?",
    r"/?(?:[A-Za-z]+[A-Za-z_-]*/|[0-9]{1,4}/)+[A-Za-z_-]*[0-9]{0,4}",
    r"(?i)(?:sha1|sha256|sha512|md5)-[A-Za-z0-9+/=]+",
)


@dataclass(frozen=True)
class ScanConfig:
    """Production settings; ``candidate`` is the least length of a candidate string."""

    candidate: int = 20
    rules: tuple[EntropyRule, ...] = RULES
    allowed: tuple[str, ...] = ALLOWED
    _compiled: dict = field(default_factory=dict, compare=False, repr=False)

    def parts(self):
        if not self._compiled:
            self._compiled["candidate"] = re.compile(rf"[A-Za-z0-9+/_=-]{{{self.candidate},}}")
            self._compiled["rules"] = [(re.compile(r.member), r) for r in self.rules]
            self._compiled["allowed"] = [re.compile(a) for a in self.allowed]
        return self._compiled["candidate"], self._compiled["rules"], self._compiled["allowed"]

    def __reduce__(self):
        return ScanConfig, (self.candidate, self.rules, self.allowed)


def hot_windows(value: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Maximal unions of windows whose entropy is at least ``bits``. A shorter value is one window."""
    window = min(window, len(value))
    if not window:
        return []
    clog = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    for ch in value[:window]:
        c = counts.get(ch, 0)
        total += clog[c + 1] - clog[c]
        counts[ch] = c + 1
    log_n, out = math.log2(window), []
    for start in range(len(value) - window + 1):
        if start:
            gone, new = value[start - 1], value[start + window - 1]
            c = counts[gone]
            total += clog[c - 1] - clog[c]
            counts[gone] = c - 1
            c = counts.get(new, 0)
            total += clog[c + 1] - clog[c]
            counts[new] = c + 1
        if log_n - total / window >= bits - 1e-9:
            if out and out[-1][1] >= start:
                out[-1] = (out[-1][0], start + window)
            else:
                out.append((start, start + window))
    return out


def find_spans(text: str, config: ScanConfig) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans of a text, sorted."""
    out: list[tuple[int, int, int]] = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    longest = max(map(len, text.split()), default=0)
    if longest >= MIN_HEX and HEX_LONG.search(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    if longest >= config.candidate:
        candidate, rules, allowed = config.parts()
        base, covered, next_base = sorted(out), 0, 0  # covered: the furthest end of the base spans that begin up to here
        for m in candidate.finditer(text):
            value, at = m[0], m.start()
            rule = next((r for p, r in rules if p.fullmatch(value)), None)
            if rule is None or any(a.fullmatch(value) for a in allowed):
                continue
            for start, end in hot_windows(value, rule.window, rule.bits):
                while next_base < len(base) and base[next_base][0] <= at + start:
                    covered = max(covered, base[next_base][2])
                    next_base += 1
                if at + end > covered:
                    out.append((at + start, 3, at + end))
    out.sort()
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]))


def redacted(text: str, spans) -> str:
    """Each span, overlapping ones together, becomes ``[SECRET]``."""
    parts, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in merged:
        parts += [text[at:s], "[SECRET]"]
        at = e
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, text: str = "text", spans: str = "secret_spans", redact: bool = False, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Add the spans of each text as an array of (start, kind, end) in column ``spans``; ``redact`` also replaces them in the text.

    A column that already has the name of ``spans`` is replaced.
    """
    kept = [c for c in docs.columns if c != spans]
    at = kept.index(text)
    schema = T.StructType([docs.schema[c] for c in kept]).add(spans, SPAN)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, at):
            texts = batch.column(at).to_pylist()
            found = [find_spans(x, config) if x else [] for x in texts]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            if redact:
                columns[at] = pa.array([redacted(x, f) if f else x for x, f in zip(texts, found, strict=True)], batch.schema.field(at).type)
            values = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in f] for f in found]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, kind)], [*kept, spans])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(over, schema)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", config: ScanConfig = ScanConfig()) -> DataFrame:
    """One row per document: counts of each base kind, a digest of the base spans, and all spans."""
    schema = T.StructType([docs.schema[key]])
    for n in ("n_assign", "n_access", "n_hex"):
        schema.add(n, T.LongType())
    schema.add("base_sha256", T.StringType()).add("spans", T.StringType()).add("n_entropy", T.LongType())

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            found = [find_spans(x, config) if x else [] for x in batch.column(1).to_pylist()]
            counts = [pa.array([sum(1 for s in f if s[1] == k) for f in found], pa.int64()) for k in range(4)]
            base = [hashlib.sha256(joined(s for s in f if s[1] < 3).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts[:3], pa.array(base, pa.string()), pa.array([joined(f) for f in found], pa.string()), counts[3]], schema.fieldNames())

    return docs.select(key, text).mapInArrow(over, schema)
