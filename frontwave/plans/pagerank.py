"""PageRank, by power iteration and by residual push.

``r(v) = (1 - alpha) + alpha * sum of r(u) / outdegree(u)`` over edges u -> v, all starting at ``1 - alpha``, until no rank moves by
``epsilon`` or more, or ``most`` rounds are done; then ranks are divided by their sum. A vertex without out-edges passes nothing on.

The shares along the edges are made once and cached by source, with an edge from each vertex to itself that carries its old
rank and no share. So a round is one join, which finds the ranks dealt by id as the last round's sums left them, and one
aggregation, the only exchange; a hub's many in-edges are summed before it. Several rounds are one job; if the stopping rule
holds within it, its rounds up to there are run again from the last written state. A hub's many out-edges are dealt apart (``hubs``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.stats import RunStats
from ..graph import Graph
from ..operators.structure import transition
from . import blocks
from .fixpoint import cut, drop, fixpoint
from .hubs import Dealt, deal

ALPHA, EPSILON, MOST_ROUNDS = 0.85, 1e-6, 200
#: Rounds of one job.
AT_ONCE = 5
#: Scale of integer residuals.
SCALE = 2**20


def _checked(alpha: float, epsilon: float) -> None:
    if not 0 <= alpha <= 1 or epsilon <= 0:
        raise ValueError("alpha must be in [0, 1] and epsilon over 0")


def _shares(graph: Graph) -> Dealt:
    return deal(transition(graph.edges))


def normalize(ranks: DataFrame) -> DataFrame:
    """Ranks divided by their sum, which is one broadcast number."""
    total = ranks.agg(F.sum("rank").alias("_total"))
    return ranks.crossJoin(F.broadcast(total)).select("id", (F.col("rank") / F.col("_total")).alias("rank"))


def pagerank(graph: Graph, alpha: float = ALPHA, epsilon: float = EPSILON, most: int = MOST_ROUNDS, rounds: int | None = None, directed: bool = True, normalized: bool = True, stats: RunStats | None = None) -> DataFrame:
    """id, rank. With ``rounds``, exactly so many are done and nothing is tested. Undirected: over both directions of each edge, once."""
    _checked(alpha, epsilon)
    stats = stats or RunStats()
    stats.start()
    owner = graph if directed else graph.symmetrize()
    own = owner.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("double").alias("p"))
    shares = deal(transition(owner.edges).select("src", "dst", "p").unionByName(own))
    stats.checkpoint("preprocessing")
    state, _ = cut(graph.vertices.select("id", F.lit(1 - alpha).alias("rank")))
    # with hubs a round reads the ranks twice, and a chain of rounds would read them again and again
    at_once = 1 if shares.heavy is not None else AT_ONCE
    most, done, converged = most if rounds is None else rounds, 0, False

    def run(now: DataFrame, n: int) -> tuple[DataFrame, list[float | None]]:
        """n more rounds from a written state, and the largest move of a rank in each."""
        moves = []
        for _ in range(n):
            met = shares.join(now.select(F.col("id").alias("src"), "rank"))
            sums = met.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"), F.max(F.when(F.col("p").isNull(), F.col("rank"))).alias("old"))
            now = sums.select("id", (F.lit(1 - alpha) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"), "old")
            moves.append(Observation())
            now = now.observe(moves[-1], F.max(F.abs(F.col("rank") - F.col("old"))).alias("delta"))
        written, _ = cut(now.select("id", "rank"))
        return written, [m.get["delta"] for m in moves]

    while done < most and not converged:
        n = min(at_once, most - done)
        following, moves = run(state, n)
        if rounds is None:
            enough = next((i + 1 for i, d in enumerate(moves) if d is None or d < epsilon), None)
            converged = enough is not None
            if converged and enough < n:
                drop(following)
                n, (following, moves) = enough, run(state, enough)
        for d in moves:
            stats.add_datapoint("delta", d or 0.0)
        drop(state)
        state, done = following, done + n
    stats.add_stat("iterations", done)
    stats.add_stat("converged", converged)
    stats.checkpoint("pagerank")
    shares.unpersist()
    ranks = state.select("id", "rank")
    ranks = normalize(ranks) if normalized else ranks
    stats.checkpoint("normalize")
    return ranks


def deltas(graph: Graph, rounds: int, alpha: float = ALPHA) -> DataFrame:
    """round, delta: the largest move of a rank in each round."""
    stats = RunStats()
    pagerank(graph, alpha=alpha, rounds=rounds, stats=stats)
    return graph.spark.createDataFrame(list(enumerate(stats.series.get("delta", []), 1)), "round int, delta double")


def residual_pagerank(graph: Graph, alpha: float = ALPHA, epsilon: float = EPSILON, most: int = MOST_ROUNDS, rounds: int | None = None, integers: bool = False, normalized: bool = True, stats: RunStats | None = None) -> DataFrame:
    """id, rank by residual push, in rounds: every active vertex adds its residual to its weight and pushes its share on.

    A vertex is active when its residual is at least ``epsilon``. With ``integers``, residuals are whole numbers of ``1 / SCALE``, and
    each edge's push is rounded down: ``floor(residual * 100 alpha / (100 outdegree))``. ``rounds`` bounds the rounds without being an error.
    Without these two only the end counts, and rounds are those of ``blocks``, which push on within a block before anything moves.
    """
    _checked(alpha, epsilon)
    stats = stats or RunStats()
    if rounds is None and not integers and most > 0:
        ranks = blocks.drained(graph, alpha, epsilon, most, stats).withColumnRenamed("weight", "rank")
        return normalize(ranks) if normalized else ranks
    graph = graph.cache()  # read for the vertices, twice for the shares and for the first push
    shares = _shares(graph)
    hundredths = round(alpha * 100)
    threshold = F.lit(epsilon * SCALE if integers else epsilon)
    if integers:
        if abs(hundredths - alpha * 100) > 1e-9:
            raise ValueError("integer mode takes alpha in hundredths")
        push = lambda r: F.col("w") * F.expr(f"({r} * {hundredths}) div (100 * deg)")
        start = F.lit(SCALE * (100 - hundredths) // 100).cast("long")
        none, weight = F.lit(0).cast("long"), F.lit(SCALE * (100 - hundredths) // 100).cast("long")
    else:
        push = lambda r: F.col(r) * alpha * F.col("p")
        start, none, weight = F.lit(1 - alpha), F.lit(0.0), F.lit(1 - alpha)

    def pushed(active: DataFrame) -> DataFrame:
        return shares.join(active.select(F.col("id").alias("src"), "residual")).groupBy(F.col("dst").alias("id")).agg(F.sum(push("residual")).alias("got"))

    first = pushed(graph.vertices.select("id", start.alias("residual")))
    state = graph.vertices.join(first, "id", "left").select("id", weight.alias("weight"), F.coalesce("got", none).alias("residual"), F.lit(True).alias("active"))

    def step(now: DataFrame, _: int) -> DataFrame:
        got = pushed(now.where("active"))
        left = F.when(F.col("active"), none).otherwise(F.col("residual"))
        moved = now.join(got, "id", "left").select("id", F.when(F.col("active"), F.col("weight") + F.col("residual")).otherwise(F.col("weight")).alias("weight"), (left + F.coalesce("got", none)).alias("residual"))
        return moved.withColumn("active", F.col("residual") >= threshold)

    def stop(seen: dict, done: int) -> bool:
        stats.add_datapoint("wl_size", seen["active"])
        return not seen["active"]

    state, done, _ = fixpoint(state, step, {"active": F.count(F.when(F.col("active"), 1))}, stop, most if rounds is None else rounds)
    stats.add_stat("iterations", done)
    shares.unpersist()
    graph.vertices.unpersist()
    graph.edges.unpersist()
    ranks = state.select("id", (F.col("weight") / SCALE if integers else F.col("weight")).alias("rank"))
    return normalize(ranks) if normalized else ranks


def top_ranked(ranks: DataFrame, k: int) -> DataFrame:
    """The k highest ranks, ties to the smaller id."""
    return ranks.orderBy(F.desc("rank"), "id").limit(k)
