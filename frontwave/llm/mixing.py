"""Mixing sources to target weights by iterative proportional fitting (raking), then calibrated sampling. DataFrames only.

Documents fall into cells (source, language, topic). The cells' token weights are raked: each round scales them so that
the source totals match their targets, then the language totals, then the topic totals. A document of a cell is then
sampled with probability ``min(1, s * raked / tokens)``, with ``s`` solved exactly so that the expected number of tokens
is ``budget`` times the corpus: cells that reach 1 are whole, and the rest share what is left. A document is in the
sample when a uniform number made from its id and a seed is below its probability, so the same documents are drawn on
every run, on any cluster, and a larger budget's sample contains a smaller one's.

Targets are shares of a margin's values; where none are given, a margin's tokens to the power ``temper`` (1 keeps the
corpus mix, 0 makes values equal). Values that occur but have no target get weight 0 and are never drawn.

Where documents have no ``topic`` column, :func:`topic` sorts texts by their form, counted over the whole text.

Only the cell table is iterated on. It is aggregated from all documents with map-side partial sums, so a hot source is no
hot task. While it has at most ``small_cells`` rows (counted) it is worked on in one partition, without shuffles, and is
broadcast to the documents; a larger one is shuffled by the margins' values, calibrated by sums alone and joined by a shuffle.

Defined results: null sources, languages and topics are values of their own, ``(none)``; null and empty texts have 0
tokens and are drawn with their cell's probability, 0 in a cell of no tokens; null ids share one uniform number; repeated
rows are drawn together; an empty table gives an empty table; extra columns pass through, but one that has the name of an
output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_unit, written

MARGINS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS, BUDGET, SEED, SMALL_CELLS = 12, 0.8, 20, 100_000
NONE = "(none)"
_CHUNK = 4

DIGITS, CAPITALS, MARKS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*@^~<>{}[]"


def tokens(text: Column) -> Column:
    """Words of a whole text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """The form of a whole text: tabular, numeric, emphatic, marked or prose."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    return (
        F.when(text.isNull(), NONE).when(share("|") > 0.02, "tabular").when(share(DIGITS) > 0.05, "numeric")
        .when(share(CAPITALS) > 0.3, "emphatic").when(share(MARKS) > 0.02, "marked").otherwise("prose")
    )


def _labelled(docs: DataFrame, text: str) -> DataFrame:
    """The documents with their cell and tokens, in columns of our own names."""
    own = {m: F.coalesce(F.col(f"`{m}`").cast("string"), F.lit(NONE)) if m in docs.columns else topic(F.col(text)) for m in MARGINS}
    count = tokens(F.col(text)) if text else F.col("mix_words")
    return docs.withColumns({f"_mix_{m}": c for m, c in own.items()} | {"_mix_tokens": count})


def slim(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What mixing needs of the documents, without their texts, made in one scan and written to the shared folder."""
    own = _labelled(docs, text)
    return written(own.select(key, *[F.col(f"_mix_{m}").alias(m) for m in MARGINS], F.col("_mix_tokens").alias("mix_words")), "mixing")


def _targets(cells: DataFrame, margin: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    """Add the target share of each row's value of a margin as ``t_<margin>``."""
    if given is not None:
        total = float(sum(given.values())) or 1.0
        share = F.coalesce(F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, v / total)])[F.col(margin)], F.lit(0.0)) if given else F.lit(0.0)
        return cells.withColumn(f"t_{margin}", share)
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("_m"))
    powered = sums.withColumn("_p", F.when(F.col("_m") > 0, F.pow("_m", F.lit(temper))).otherwise(0.0))
    total = powered.agg(F.sum("_p").alias("_all"))
    return cells.join(powered.crossJoin(F.broadcast(total)).select(margin, (F.col("_p") / F.col("_all")).alias(f"t_{margin}")), margin)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, rounds: int = ROUNDS, small_cells: int = SMALL_CELLS) -> tuple[DataFrame, int]:
    """Add ``raked`` to cells of (source, lang, topic, tokens); also the number of cells.

    The raked weights sum to the corpus's tokens. Every few rounds the table is written to the shared folder, which keeps
    the plan short.
    """
    for m in MARGINS:
        cells = _targets(cells, m, (targets or {}).get(m), (temper or TEMPER)[m])
    cells = written(cells.withColumn("raked", F.col("tokens").cast("double")), "cells")
    n = cells.count()
    for done in range(0, rounds, _CHUNK):
        cells = cells.coalesce(1) if n <= small_cells else cells
        total = F.sum("tokens").over(Window.partitionBy(F.lit(0))) if n <= small_cells else None
        if total is None:
            cells = cells.drop("_total").crossJoin(F.broadcast(cells.agg(F.sum("tokens").cast("double").alias("_total"))))
        else:
            cells = cells.withColumn("_total", total.cast("double"))
        for _ in range(done, min(done + _CHUNK, rounds)):
            for m in MARGINS:
                have = F.sum("raked").over(Window.partitionBy(m))
                cells = cells.withColumn("raked", F.when(have > 0, F.col("raked") * F.col(f"t_{m}") * F.col("_total") / have).otherwise(0.0))
        cells = written(cells, "cells")
    return cells.drop(*[f"t_{m}" for m in MARGINS], "_total"), n


def calibrate(cells: DataFrame, budget: float = BUDGET, sorted_once: bool = True) -> DataFrame:
    """Add ``probability`` to raked cells.

    With the cells in falling order of raked / tokens, those before a place k are whole and the rest are scaled by s_k to
    use up the budget; the first k at which no scaled cell exceeds 1 is the solution. It is found from sums over the order in
    one task, or, if not ``sorted_once``, by sums over all cells: the scale that fills the budget makes some cells whole,
    which raises the scale for the others, until no further cell is whole.
    """
    ranked = cells.withColumn("_ratio", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(0.0))
    if not sorted_once:
        return _probable(ranked, F.lit(_scale(ranked, budget)).cast("double"))
    order = Window.orderBy(F.col("_ratio").desc(), *MARGINS)
    upto, from_here = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    steps = ranked.withColumn("_s", (F.lit(budget) * F.sum("tokens").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum("tokens").over(upto), F.lit(0))) / F.sum("raked").over(from_here))
    solved = steps.where("_ratio > 0 and _s >= 0 and _s * _ratio <= 1 + 1e-12").agg(F.min_by("_s", F.struct(-F.col("_ratio"), *MARGINS)).alias("_scale"))
    return _probable(ranked.crossJoin(F.broadcast(solved)), F.col("_scale")).drop("_scale")


def _probable(ranked: DataFrame, scale: Column) -> DataFrame:
    return ranked.withColumn("probability", F.when(F.col("_ratio") <= 0, 0.0).when(scale.isNull(), 1.0).otherwise(F.least(F.lit(1.0), scale * F.col("_ratio"))))


def _scale(ranked: DataFrame, budget: float) -> float | None:
    """The scale of the cells that are not whole; None if all are."""
    total, raked = ranked.agg(F.sum("tokens").cast("double"), F.sum("raked")).first()
    scale = budget * total / raked if raked else None
    while scale is not None:
        whole = F.col("_ratio") * F.lit(scale) > 1 + 1e-12
        tokens, rest = ranked.agg(F.coalesce(F.sum(F.when(whole, F.col("tokens"))), F.lit(0)).cast("double"), F.sum(F.when(~whole, F.col("raked")))).first()
        after = (budget * total - tokens) / rest if rest and budget * total >= tokens else None
        if after is not None and after <= scale * (1 + 1e-12):
            return scale
        scale = after
    return None


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, budget: float = BUDGET, rounds: int = ROUNDS, seed: int = SEED, small_cells: int = SMALL_CELLS) -> DataFrame:
    """Add mix_topic, mix_tokens, mix_weight (raked / tokens of the cell), mix_probability and mix_sampled to every document.

    An empty name of the text column stands for documents from :func:`slim`.
    """
    labelled = _labelled(docs.drop("mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_sampled"), text)
    cells = labelled.groupBy(*[F.col(f"_mix_{m}").alias(m) for m in MARGINS]).agg(F.sum("_mix_tokens").alias("tokens"))
    raked, n = rake(cells, targets, temper, rounds, small_cells)
    solved = calibrate(raked, budget, n <= small_cells).select(*[F.col(m).alias(f"_mix_{m}") for m in MARGINS], F.col("_ratio").alias("mix_weight"), F.col("probability").alias("mix_probability"))
    solved = F.broadcast(solved) if n <= small_cells else solved
    joined = labelled.join(solved, [f"_mix_{m}" for m in MARGINS])
    unit = hash_unit(F.coalesce(F.col(key).cast("string"), F.lit(NONE)), seed)
    return joined.withColumns({"mix_topic": F.col("_mix_topic"), "mix_tokens": F.col("_mix_tokens"), "mix_sampled": unit < F.col("mix_probability")}).select(*[c for c in docs.columns if not c.startswith("mix_")], "mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_sampled")


def report(docs: DataFrame) -> DataFrame:
    """The query's rows: every document with its cell's weight and probability, and whether it is drawn."""
    got = mix(slim(docs), text="")
    return got.select("doc_id", "mix_topic", "mix_tokens", F.round("mix_weight", 6).alias("mix_weight"), F.round("mix_probability", 6).alias("mix_probability"), "mix_sampled")


def sample_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: the drawn documents, with their own columns."""
    return mix(docs).where("mix_sampled").select(*docs.columns)


def report_sql(documents: str = "documents") -> str:
    """DuckDB SQL for :func:`report`."""
    share = lambda chars: f"(length(text) - length(translate(text, '{chars}', ''))) / greatest(length(text), 1)"
    ctes = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  CASE WHEN text IS NULL THEN '{NONE}' WHEN {share("|")} > 0.02 THEN 'tabular' WHEN {share(DIGITS)} > 0.05 THEN 'numeric'
       WHEN {share(CAPITALS)} > 0.3 THEN 'emphatic' WHEN {share(MARKS)} > 0.02 THEN 'marked' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT AS tokens FROM {documents})""",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)",
    ]
    for m in MARGINS:
        ctes.append(f"m_{m} AS MATERIALIZED (SELECT {m}, p / sum(p) OVER () AS t FROM (SELECT {m}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {TEMPER[m]}) ELSE 0 END AS p FROM c GROUP BY {m}))")
    ctes.append("r0 AS MATERIALIZED (SELECT c.*, m_source.t AS t_source, m_lang.t AS t_lang, m_topic.t AS t_topic, tokens AS raked, sum(tokens) OVER () AS total FROM c JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic))")
    k = 0
    for _ in range(ROUNDS):
        for m in MARGINS:
            have = f"sum(raked) OVER (PARTITION BY {m})"
            ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {have} > 0 THEN raked * t_{m} * total / {have} ELSE 0 END AS raked) FROM r{k})")
            k += 1
    order = "ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN"
    ctes.append(f"s AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN raked / tokens ELSE 0 END AS ratio FROM r{k})")
    ctes.append(f"f AS (SELECT *, ({BUDGET} * total - coalesce(sum(tokens) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(raked) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM s)")
    ctes.append("g AS (SELECT arg_max(scale, ratio) AS scale FROM f WHERE ratio > 0 AND scale >= 0 AND scale * ratio <= 1 + 1e-12)")
    ctes.append("p AS MATERIALIZED (SELECT source, lang, topic, ratio, CASE WHEN ratio <= 0 THEN 0 WHEN g.scale IS NULL THEN 1 ELSE least(1, g.scale * ratio) END AS probability FROM s CROSS JOIN g)")
    unit = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '{NONE}') || ':{SEED}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, topic AS mix_topic, d.tokens AS mix_tokens, round(ratio, 6) AS mix_weight, round(probability, 6) AS mix_probability, {unit} < probability AS mix_sampled
FROM d JOIN p USING (source, lang, topic)"""
