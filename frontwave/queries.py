"""The registered graph queries and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .plans import bfs as _bfs
from .operators import layout
from .plans import deltas, distances, frontier_sizes, level_lines, levels, pagerank, residual_pagerank, top_ranked, unreached
from .plans.fixpoint import shared_dir
from .sources import read_binary, read_edge_list, write_binary, write_pairs
from .sources.sinks import write_levels
from .tablegraphs import EDGE_SQL, graph

Query = Callable[[SparkSession, str], DataFrame]
K = 20
BLOCK = 256


def _least(g: Graph) -> int:
    """The least source id, at which searches start; -1 for no edges."""
    found = g.edges.agg(F.min("src")).first()[0]
    return -1 if found is None else found


def _on(name: str, make: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(graph(spark, sf_dir, name))


def _search(name: str, make: Callable[[Graph, int], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir, name).cache()
        return make(g, _least(g))

    return run


def _file(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


def text_edges(g: Graph) -> DataFrame:
    """The edges, written as text and read back."""
    path = _file(g.spark)
    write_pairs(g, path)
    return read_edge_list(g.spark, path, header="none").edges


def binary_edges(g: Graph) -> DataFrame:
    """The edges, written as a binary file and read back."""
    path, last = f"{_file(g.spark)}.gr", g.vertices.agg(F.max("id")).first()[0]
    write_binary(Graph.of(g.edges, num_nodes=0 if last is None else last + 1), path)
    return read_binary(g.spark, path).edges


def written_levels(g: Graph, source: int) -> DataFrame:
    """The lines of a file of distances, read back."""
    path = _file(g.spark)
    write_levels(distances(g, source, directed=False), path)
    return g.spark.read.text(path).select(F.col("value").alias("line"))


def _ranked(ranks: DataFrame, places: int = 8) -> DataFrame:
    return ranks.select("id", F.round("rank", places).alias("rank"))


QUERIES: dict[str, Query] = {
    "edge_list": _on("seq", lambda g: g.edges),
    "vertex_set": _on("seq", lambda g: g.vertices),
    "graph_summary": _on("supply", lambda g: g.summary()),
    "text_edges": _on("seq", text_edges),
    "binary_edges": _on("seq", binary_edges),
    "head_tail": _on("supply", lambda g: layout.head_tail(g.out_degree(), "out_degree")),
    "written_levels": _search("seq", written_levels),
    "bfs_first_levels": _search("op", lambda g, s: level_lines(levels(g, s, directed=False), 100)),
    "out_degree": _on("supply", lambda g: g.out_degree()),
    "in_degree": _on("supply", lambda g: g.in_degree()),
    "max_out_degree": _on("supply", lambda g: g.max_out_degree()),
    "csr_offsets": _on("seq", lambda g: g.csr_offsets()),
    "adjacency": _on("seq", lambda g: g.adjacency().select("src", F.array_join("neighbours", ",").alias("neighbours"))),
    "neighbours": _search("seq", lambda g, s: g.neighbours(s)),
    "flip": _on("seq", lambda g: g.flip().edges),
    "symmetrize": _on("seq", lambda g: g.symmetrize().edges),
    "dedupe_edges": _on("seq", lambda g: g.dedupe().edges),
    "duplicate_edges": _on("seq", lambda g: g.duplicate_edges()),
    "graph_preview": _on("seq", lambda g: g.preview()),
    "node_info": _search("seq", lambda g, s: g.node_info(s)),
    "row_blocks": _on("seq", lambda g: g.row_blocks(BLOCK)),
    "bfs_directed": _search("seq", lambda g, s: levels(g, s)),
    "bfs_undirected": _search("op", lambda g, s: _bfs(g, s, directed=False).select("id", (F.col("distance") + 1).cast("int").alias("level"))),
    "bfs_levels_all": _search("op", lambda g, s: levels(g, s, directed=False)),
    "bfs_distance": _search("op", lambda g, s: distances(g, s, directed=False)),
    "bfs_level_histogram": _search("op", lambda g, s: frontier_sizes(g, s, directed=False)),
    "bfs_unreached_count": _search("home", lambda g, s: unreached(g, s, directed=False)),
    "pagerank_k20": _on("seq", lambda g: _ranked(pagerank(g, rounds=K))),
    "pagerank_raw": _on("seq", lambda g: _ranked(pagerank(g, rounds=K, normalized=False))),
    "pagerank_dangling": _on("supply", lambda g: _ranked(pagerank(g, rounds=K))),
    "pagerank_undirected": _on("seq", lambda g: _ranked(pagerank(g, rounds=K, directed=False))),
    "pagerank_converged": _on("seq", lambda g: _ranked(pagerank(g, epsilon=1e-7), 6)),
    "pagerank_topk": _on("seq", lambda g: top_ranked(_ranked(pagerank(g, rounds=K)), 10)),
    "pagerank_delta": _on("seq", lambda g: deltas(g, K).select("round", F.round("delta", 7).alias("delta"))),
    "pagerank_residual": _on("seq", lambda g: _ranked(residual_pagerank(g, epsilon=1e-7), 6)),
    "pagerank_fixed_point": _on("seq", lambda g: residual_pagerank(g, rounds=12, integers=True, normalized=False).select("id", F.round(F.col("rank") * 2**20).cast("long").alias("weight"))),
}


# ---- SQL


def _bfs_sql(name: str, both: bool, outer: str) -> str:
    edges = f"SELECT src, dst FROM ({EDGE_SQL[name]}) e"
    if both:
        edges += f" UNION SELECT dst, src FROM ({EDGE_SQL[name]}) f"
    return f"""WITH RECURSIVE t AS MATERIALIZED ({edges}),
v AS (SELECT src AS id FROM t UNION SELECT dst FROM t),
b(v, lvl) USING KEY (v) AS (
  SELECT min(src)::BIGINT, 1 FROM ({EDGE_SQL[name]}) g
  UNION
  SELECT t.dst, min(b.lvl + 1) FROM b JOIN t ON t.src = b.v
  LEFT JOIN recurring.b seen ON seen.v = t.dst
  WHERE seen.v IS NULL GROUP BY t.dst)
{outer}"""


def _rank_sql(name: str, rounds: int, outer: str, both: bool = False) -> str:
    edges = EDGE_SQL[name]
    if both:
        edges = f"SELECT src, dst FROM ({edges}) a UNION SELECT dst, src FROM ({edges}) b"
    return f"""WITH RECURSIVE
e AS (SELECT src, dst, count(*) w FROM ({edges}) g GROUP BY 1, 2),
v AS (SELECT src id FROM e UNION SELECT dst FROM e),
d AS (SELECT src, sum(w) deg FROM e GROUP BY 1),
x AS (SELECT e.src, e.dst, e.w / d.deg::DOUBLE p FROM e JOIN d USING (src)
      UNION ALL SELECT NULL, id, 0 FROM v),
pr(it, id, r) AS (
  SELECT 0, id, 0.15::DOUBLE FROM v
  UNION ALL
  SELECT m + 1, dst, 0.15 + 0.85 * s FROM (
    SELECT max(k.it) m, x.dst, sum(coalesce(pr.r, 0) * x.p) s
    FROM x CROSS JOIN (SELECT max(it) it FROM pr) k LEFT JOIN pr ON pr.id = x.src
    GROUP BY x.dst) y WHERE m < {rounds})
{outer}"""


def _fixed_point_sql(name: str, rounds: int) -> str:
    start = 2**20 * 15 // 100
    return f"""WITH RECURSIVE
e AS (SELECT src, dst, count(*)::BIGINT w FROM ({EDGE_SQL[name]}) g GROUP BY 1, 2),
v AS (SELECT src id FROM e UNION SELECT dst FROM e),
d AS (SELECT src, sum(w)::BIGINT deg FROM e GROUP BY 1),
x AS (SELECT e.src, e.dst, e.w, d.deg FROM e JOIN d USING (src) UNION ALL SELECT NULL, id, 0, 1 FROM v),
s0 AS (SELECT dst AS id, sum(w * (({start}::BIGINT * 85) // (100 * deg)))::BIGINT AS res FROM x GROUP BY dst),
s(it, id, weight, res, act) AS (
  SELECT 0, id, {start}::BIGINT, res, true FROM s0
  UNION ALL
  SELECT it + 1, id, weight, left_over + got, left_over + got >= 1.048576 FROM (
    SELECT max(k.it) AS it, x.dst AS id,
      max(CASE WHEN o.act THEN o.weight + o.res ELSE o.weight END) AS weight,
      max(CASE WHEN o.act THEN 0 ELSE o.res END) AS left_over,
      sum(CASE WHEN s.act THEN x.w * ((s.res * 85) // (100 * x.deg)) ELSE 0 END)::BIGINT AS got
    FROM x CROSS JOIN (SELECT max(it) it FROM s) k LEFT JOIN s ON s.id = x.src JOIN s o ON o.id = x.dst
    GROUP BY x.dst) y WHERE it < {rounds})
SELECT id, weight FROM s WHERE it = {rounds}"""


def _degree_sql(name: str, end: str, alias: str) -> str:
    return f"""WITH e AS ({EDGE_SQL[name]}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)
SELECT v.id, coalesce(c.n, 0)::BIGINT AS {alias} FROM v LEFT JOIN (SELECT {end} AS id, count(*) AS n FROM e GROUP BY 1) c USING (id)"""


_NORMAL = f"SELECT id, round(r / sum(r) OVER (), 8) AS rank FROM pr WHERE it = {K}"
_LISTS = "array_to_string(list_sort(list(dst)), ',')"

ORACLE_SQL: dict[str, str] = {
    "edge_list": EDGE_SQL["seq"],
    "vertex_set": f"SELECT src AS id FROM ({EDGE_SQL['seq']}) a UNION SELECT dst FROM ({EDGE_SQL['seq']}) b",
    "graph_summary": f"""WITH e AS ({EDGE_SQL['supply']}) SELECT
  (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e) v)::BIGINT AS num_nodes, (SELECT count(*) FROM e)::BIGINT AS num_edges,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY src) d)::BIGINT AS max_outdegree""",
    "text_edges": EDGE_SQL["seq"],
    "binary_edges": EDGE_SQL["seq"],
    "head_tail": f"""WITH d AS ({_degree_sql("supply", "src", "out_degree")}), r AS (SELECT *, row_number() OVER (ORDER BY id) AS a, row_number() OVER (ORDER BY id DESC) AS b FROM d)
SELECT id, out_degree FROM r WHERE a <= 6 OR b <= 4""",
    "written_levels": _bfs_sql("seq", True, "SELECT v::VARCHAR || ' ' || (lvl - 1)::VARCHAR AS line FROM b"),
    "bfs_first_levels": _bfs_sql("op", True, "SELECT v AS id, lvl::INTEGER AS level FROM b ORDER BY lvl, v LIMIT 100"),
    "out_degree": _degree_sql("supply", "src", "out_degree"),
    "in_degree": _degree_sql("supply", "dst", "in_degree"),
    "max_out_degree": f"SELECT max(n)::BIGINT AS max_outdegree FROM (SELECT count(*) AS n FROM ({EDGE_SQL['supply']}) e GROUP BY src) d",
    "csr_offsets": f"SELECT id, out_degree, (sum(out_degree) OVER (ORDER BY id) - out_degree)::BIGINT AS \"offset\" FROM ({_degree_sql('seq', 'src', 'out_degree')}) d",
    "adjacency": f"SELECT src, {_LISTS} AS neighbours FROM ({EDGE_SQL['seq']}) e GROUP BY src",
    "neighbours": f"WITH e AS ({EDGE_SQL['seq']}) SELECT src, dst FROM e WHERE src = (SELECT min(src) FROM e)",
    "flip": f"SELECT dst AS src, src AS dst FROM ({EDGE_SQL['seq']}) e",
    "symmetrize": f"SELECT src, dst FROM ({EDGE_SQL['seq']}) a UNION SELECT dst, src FROM ({EDGE_SQL['seq']}) b",
    "dedupe_edges": f"SELECT DISTINCT src, dst FROM ({EDGE_SQL['seq']}) e",
    "duplicate_edges": f"SELECT src, dst, count(*) AS copies FROM ({EDGE_SQL['seq']}) e GROUP BY 1, 2 HAVING count(*) > 1",
    "graph_preview": f"""WITH e AS ({EDGE_SQL['seq']}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
r AS (SELECT id, row_number() OVER (ORDER BY id) AS a, row_number() OVER (ORDER BY id DESC) AS b FROM v)
SELECT r.id, coalesce(l.n, 0)::BIGINT AS out_degree, coalesce(l.neighbours, '') AS neighbours
FROM r LEFT JOIN (SELECT src AS id, count(*) AS n, {_LISTS} AS neighbours FROM e GROUP BY 1) l USING (id) WHERE a <= 5 OR b <= 5""",
    "node_info": f"""WITH e AS ({EDGE_SQL['seq']}), s AS (SELECT min(src) AS id FROM e)
SELECT s.id, (SELECT count(*) FROM e WHERE src = s.id) AS out_degree, (SELECT count(*) FROM e WHERE src < s.id) AS first_edge,
  (SELECT count(*) FROM e WHERE src <= s.id) AS end_edge, (SELECT {_LISTS} FROM e WHERE src = s.id) AS neighbours FROM s""",
    "row_blocks": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, out_degree FROM ({_degree_sql('seq', 'src', 'out_degree')}) q),
f(pos, size, opens) AS (
  SELECT 0::BIGINT, (SELECT out_degree FROM d WHERE pos = 0), true
  UNION ALL
  SELECT d.pos, CASE WHEN f.size + d.out_degree > {BLOCK} THEN d.out_degree ELSE f.size + d.out_degree END, f.size + d.out_degree > {BLOCK}
  FROM f JOIN d ON d.pos = f.pos + 1),
c AS (SELECT pos AS first_row FROM f WHERE opens UNION ALL SELECT count(*) FROM d)
SELECT (row_number() OVER (ORDER BY first_row) - 1)::INTEGER AS block, first_row::BIGINT AS first_row FROM c""",
    "bfs_directed": _bfs_sql("seq", False, "SELECT v.id, coalesce(b.lvl, 0)::INTEGER AS level FROM v LEFT JOIN b ON b.v = v.id"),
    "bfs_undirected": _bfs_sql("op", True, "SELECT v AS id, lvl::INTEGER AS level FROM b"),
    "bfs_levels_all": _bfs_sql("op", True, "SELECT v.id, coalesce(b.lvl, 0)::INTEGER AS level FROM v LEFT JOIN b ON b.v = v.id"),
    "bfs_distance": _bfs_sql("op", True, "SELECT v AS id, (lvl - 1)::INTEGER AS distance FROM b"),
    "bfs_level_histogram": _bfs_sql("op", True, "SELECT lvl::INTEGER AS level, count(*) AS vertices FROM b GROUP BY 1"),
    "bfs_unreached_count": _bfs_sql("home", True, "SELECT (SELECT count(*) FROM v) - (SELECT count(*) FROM b) AS unreached"),
    "pagerank_k20": _rank_sql("seq", K, _NORMAL),
    "pagerank_raw": _rank_sql("seq", K, f"SELECT id, round(r, 8) AS rank FROM pr WHERE it = {K}"),
    "pagerank_dangling": _rank_sql("supply", K, _NORMAL),
    "pagerank_undirected": _rank_sql("seq", K, _NORMAL, both=True),
    "pagerank_converged": _rank_sql("seq", 150, "SELECT id, round(r / sum(r) OVER (), 6) AS rank FROM pr WHERE it = 150"),
    "pagerank_topk": _rank_sql("seq", K, f"SELECT id, rank FROM ({_NORMAL}) n ORDER BY rank DESC, id LIMIT 10"),
    "pagerank_delta": _rank_sql("seq", K, "SELECT a.it::INTEGER AS round, round(max(abs(a.r - b.r)), 7) AS delta FROM pr a JOIN pr b ON a.id = b.id AND a.it = b.it + 1 GROUP BY 1"),
    "pagerank_residual": _rank_sql("seq", 150, "SELECT id, round(r / sum(r) OVER (), 6) AS rank FROM pr WHERE it = 150"),
    "pagerank_fixed_point": _fixed_point_sql("seq", 12),
}
