"""Document fingerprints: bottom-k sketches of shingle hashes. DataFrames only.

A text's shingles are its runs of five lower-cased words (all its words, if fewer); its sketch is the ``k`` least distinct
48-bit hashes of them, in rising order. Sketches of parts merge into the sketch of the whole: the ``k`` least of their
union. Two sketches estimate

* resemblance (Jaccard similarity): among the ``k`` least hashes of both together, the share that both have;
* containment of the first in the second: resemblance scaled by the distinct counts;
* the number of distinct shingles: exact under ``k``, else ``(k - 1) / (k-th least hash as a fraction)``.

Defined results: null and empty texts, and texts of white space only, have the empty sketch, of 0 shingles; two empty
sketches resemble each other by 1, an empty and another by 0; equal texts have equal sketches; repeated rows each get a
sketch; an empty table gives an empty table; extra columns pass through :func:`sketch`, but one named like its output is
replaced. Whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS, K, BITS = 5, 128, 48
_SPACE = 2**BITS


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(F.translate(F.coalesce(text, F.lit("")), "\t\n\r\f\x0b", "     ")), " "), lambda w: w != "")


def shingle_hashes(own: Column, size: int = WORDS) -> Column:
    """A 48-bit hash of each shingle of an array of words. ``own`` is a column: an expression would be worked out anew for each shingle."""
    n = F.size(own)
    every = F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1)))
    return F.when(n > 0, F.transform(every, lambda i: F.shiftrightunsigned(F.xxhash64(F.slice(own, i, size)), 64 - BITS))).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    """The k least distinct values of a column of hashes. Of many, only those under a bound that 2k are expected to pass are sorted; if fewer than k do, all are."""
    some = F.array_distinct(F.filter(hashes, lambda h: h.cast("double") < F.lit(2.0 * k * _SPACE) / F.size(hashes)))
    return F.when(F.size(hashes) <= 4 * k, F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)).otherwise(
        F.when(F.size(some) >= k, F.slice(F.array_sort(some), 1, k)).otherwise(F.slice(F.array_sort(F.array_distinct(hashes)), 1, k))
    )


def sketch(docs: DataFrame, text: str = "text", output: str = "sketch", k: int = K, size: int = WORDS) -> DataFrame:
    """Add the sketch of each text."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != output]
    split = docs.select(*kept, words(F.col(f"`{text}`")).alias("_words"))
    hashed = split.select(*kept, shingle_hashes(F.col("_words"), size).alias("_hashes"))
    return hashed.select(*kept, bottom(F.col("_hashes"), k).alias(output))


def merged(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """The sketch of each group of parts.

    Hashes are made distinct and cut to each group's k least before and after the shuffle (the window's group limit), so a
    group of any size sends k hashes from each task.
    """
    each = sketches.select(*keys, F.explode(column).alias("_h")).distinct()
    least = each.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_n") <= k)
    found = least.groupBy(*keys).agg(F.array_sort(F.collect_list("_h")).alias(column))
    every = sketches.select(*keys).distinct()
    same = [every[x].eqNullSafe(found[x]) for x in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return every.join(found, on, "left").select(*[every[x] for x in keys], F.coalesce(found[column], F.array().cast("array<bigint>")).alias(column))


def distinct_shingles(one: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles of a sketch."""
    return F.when(F.size(one) < k, F.size(one).cast("double")).otherwise(F.lit(float((k - 1) * _SPACE)) / F.greatest(F.element_at(one, k).cast("double"), F.lit(1.0)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketches. Both have at most k hashes, so a hash is among the k least of both exactly if at most k hashes of the union are not over it."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(union), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first's shingles that the second has: ``J / (1 + J) * (|A| + |B|) / |A|``, at most 1."""
    j, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / F.greatest(na, F.lit(1.0))))


def printed(one: Column) -> Column:
    """A sketch as a string: 12 hex digits for each hash."""
    return F.array_join(F.transform(one, lambda h: F.lpad(F.lower(F.hex(h)), 12, "0")), "")


# ---- each document and its successor

_FAN = 64


def _bucket(ids: Column, tops: list, subs: list[list]) -> Column:
    """The number of bounds below an id, by two short searches."""
    if not tops and not subs:
        return F.lit(0)
    top = F.size(F.filter(F.array(*map(F.lit, tops)), lambda b: b < ids)) if tops else F.lit(0)
    table = F.array(*[F.array(*map(F.lit, s)).cast("array<bigint>") for s in subs])
    return F.when(ids.isNull(), 0).otherwise(top * _FAN + F.size(F.filter(F.element_at(table, top + 1), lambda b: b < ids)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 512, quantiles: int = _FAN * _FAN) -> DataFrame:
    """key, text, _bucket, _order, _guest: each document once, and in each bucket of rising keys a guest copy of the next bucket's first row.

    The buckets' bounds are quantiles of all keys (at most 4096, so of fixed size); where that leaves more than
    ``rows_per_bucket`` rows, the keys between two of them are cut into up to 64 parts of equal width, so that no task holds
    the whole order. After the last bucket comes the first one.
    """
    base = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, low, high = base.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    wanted = min(quantiles, max(1, -(-n // rows_per_bucket)))
    bounds = []
    if wanted > 1 and low is not None:
        bounds = sorted(set(base.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 10_000)).first()[0]))
    tops = bounds[_FAN - 1 :: _FAN]
    subs = [bounds[i * _FAN : i * _FAN + _FAN - 1] for i in range(len(tops) + 1)] if bounds else []
    rows = base.withColumn("_bucket", _bucket(F.col(key), tops, subs))
    cuts = min(_FAN, -(-n // (wanted * rows_per_bucket)))
    if cuts > 1 and low is not None:
        edges = F.array(*map(F.lit, [low, *bounds, high])).cast("array<double>")
        down, up = F.element_at(edges, F.col("_bucket") + 1), F.element_at(edges, F.col("_bucket") + 2)
        part = F.when(F.col(key).isNull() | (up <= down), 0).otherwise(F.least(F.lit(cuts - 1), F.greatest(F.lit(0), F.floor((F.col(key).cast("double") - down) * cuts / (up - down)))))
        rows = rows.withColumn("_bucket", F.col("_bucket") * cuts + part.cast("int"))
    firsts = rows.groupBy("_bucket").agg(F.min(F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("id"))).alias("first")).select("_bucket", "first.id")
    order = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = firsts.select(F.col("_bucket").alias("_of"), "id", F.coalesce(F.lag("_bucket").over(Window.orderBy("_bucket")), F.last("_bucket").over(order)).alias("_to"))
    first_rows = rows.join(F.broadcast(before), (F.col("_bucket") == F.col("_of")) & F.col(key).eqNullSafe(F.col("id")))
    guests = first_rows.groupBy("_to").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias(key), "text", F.col("_to").alias("_bucket"), F.lit(True).alias("_guest"))
    return rows.withColumn("_guest", F.lit(False)).unionByName(guests)


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document's.

    The edited text has the last half (rounded down) of the code points replaced by as many from the start of the next
    document, or all it has. Rows of equal ids are ordered by their text, null ids come first.
    """
    placed = with_next(docs, key, text).repartition("_bucket")
    own = sketch(placed, "text", "_sketch", k)
    order = Window.partitionBy("_bucket").orderBy("_guest", F.col(key).asc_nulls_first(), "text")
    pairs = own.withColumns({"_next": F.lead("text").over(order), "_next_sketch": F.lead("_sketch").over(order)}).where(~F.col("_guest"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.select(key, n.cast("long").alias("n_chars"), "_sketch", "_next_sketch", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half)).alias("_edited"))
    both = sketch(edited, "_edited", "_edited_sketch", k)
    return both.select(
        key, "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), printed(F.col("_sketch")).alias("fingerprint"), printed(F.col("_edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_edited_sketch"), k).alias("near_edited"), resemblance(F.col("_sketch"), F.col("_next_sketch"), k).alias("near_next"), distinct_shingles(F.col("_sketch"), k).alias("distinct_shingles"), containment(F.col("_edited_sketch"), F.col("_sketch"), k).alias("edited_within"),
    )
