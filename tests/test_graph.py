import importlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from frontwave.functions import RunStats
from frontwave.graph import Graph
from frontwave.operators import layout
from frontwave.plans import bfs, deltas, distances, levels, pagerank, residual_pagerank, top_ranked, unreached
from frontwave.sources import complete_graph, focus_graph, load, read_binary, read_edge_list, read_golden_list, uniform_graph, write_binary
from frontwave.plans.hubs import deal
from frontwave.sources.sinks import bfs_lines, rank_lines
from frontwave.sources.text import digits

bfs_module, pagerank_module = (importlib.import_module(f"frontwave.plans.{n}") for n in ("bfs", "pagerank"))

SIMPLE = [(0, 1), (0, 2), (0, 3), (1, 2), (2, 3), (3, 4), (2, 0), (3, 2), (4, 3), (1, 4)]
# Converged, normalized ranks of the graph above.
SIMPLE_RANKS = [0.1338734892, 0.0679308219, 0.2444082099, 0.3473100909, 0.2064773880]
SMALL = [(1, 5), (2, 4), (3, 4), (4, 1), (5, 3)]
# Ranks of SMALL after 30 in-place sweeps, directed and undirected, and undirected distances from 1.
SMALL_DIRECTED = {1: 0.24534314077838054, 2: 0.030000000000000006, 3: 0.23276041921237994, 4: 0.2533448715039771, 5: 0.23854166966162346}
SMALL_UNDIRECTED = {1: 0.19738933380447052, 2: 0.11333212184870772, 3: 0.19738933380447052, 4: 0.29411337123073317, 5: 0.19778093373379993}
SMALL_DISTANCES = {1: 0, 2: 2, 3: 2, 4: 1, 5: 1}

# A graph of twenty edges, undirected distances from 1, and directed ranks after 30 in-place sweeps.
TWENTY = "1 11;2 19;3 18;4 2;5 12;6 10;7 2;8 4;9 18;10 15;11 8;12 1;13 11;14 13;15 9;16 5;17 14;18 19;19 17;20 12"
TWENTY_DISTANCES = "1 0;12 1;11 1;13 2;5 2;8 2;20 2;16 3;14 3;4 3;2 4;17 4;19 5;7 5;18 6;9 7;3 7;15 8;10 9;6 10"
TWENTY_RANKS = (
    "19:0.11524908910008787;11:0.10898569082781749;17:0.10546172573507469;8:0.10013783720364487;14:0.09716982510620692;4:0.09263148932307039;2:0.09257389986039748;"
    "13:0.09009696102848512;18:0.034189734375;1:0.029318437500000002;12:0.025668750000000004;9:0.023899687500000003;15:0.019293750000000005;5:0.013875;10:0.013875;3:0.0075;6:0.0075;7:0.0075;16:0.0075;20:0.0075"
)
# A graph of a hundred edges, of whose vertices 79 are reached from 1, undirected, at most 20 hops away.
HUNDRED = (
    "1 9;2 30;3 9;4 30;5 48;6 16;7 86;8 34;9 71;10 55;11 86;12 47;13 17;14 58;15 81;16 35;17 26;18 88;19 85;20 44;21 48;22 24;23 81;24 23;25 58;26 20;27 87;28 51;29 72;30 82;31 94;32 52;33 53;34 16;"
    "35 26;36 55;37 75;38 95;39 26;40 55;41 85;42 87;43 83;44 28;45 64;46 38;47 63;48 31;49 20;50 13;51 55;52 83;53 71;54 91;55 65;56 37;57 81;58 1;59 80;60 45;61 36;62 1;63 87;64 32;65 81;66 21;67 77;"
    "68 62;69 40;70 49;71 22;72 1;73 27;74 39;75 79;76 16;77 86;78 76;79 82;80 37;81 19;82 42;83 16;84 39;85 100;86 33;87 56;88 89;89 1;90 16;91 10;92 41;93 62;94 62;95 27;96 56;97 65;98 76;99 41;100 44"
)


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def simple(spark):
    return Graph.of(edges(spark, SIMPLE), num_nodes=5)


def pairs(df):
    return sorted(map(tuple, df.collect()))


def column(df):
    return dict(map(tuple, df.collect()))


def test_structure(spark):
    g = simple(spark)
    assert column(g.out_degree()) == {0: 3, 1: 2, 2: 2, 3: 2, 4: 1}
    assert column(g.in_degree()) == {0: 1, 1: 1, 2: 3, 3: 3, 4: 2}
    assert g.summary().first().asDict() == {"num_nodes": 5, "num_edges": 10, "max_outdegree": 3}
    assert g.max_out_degree().first()[0] == 3
    assert pairs(g.flip().flip().edges) == sorted(SIMPLE)
    assert pairs(g.symmetrize().edges) == sorted({*SIMPLE, *((b, a) for a, b in SIMPLE)})
    twice = Graph.of(edges(spark, [*SIMPLE, (0, 1), (2, 2)]))
    assert pairs(twice.duplicate_edges()) == [(0, 1, 2)]
    assert pairs(twice.dedupe().edges) == sorted({*SIMPLE, (2, 2)})


def test_layout(spark):
    g = simple(spark)
    assert [tuple(r) for r in g.csr_offsets().orderBy("id").collect()] == [(0, 3, 0), (1, 2, 3), (2, 2, 5), (3, 2, 7), (4, 1, 9)]
    assert g.csr_offsets(end=True).where("id is null").first()["offset"] == 10
    assert column(g.adjacency())[0] == [1, 2, 3]
    assert tuple(g.node_info(1).first()) == (1, 2, 3, 5, "2,4")
    assert g.node_info(9).count() == 0
    assert g.preview().count() == 5
    big = complete_graph(spark, 12).preview()
    assert sorted(r.id for r in big.collect()) == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11]
    assert " . . ." in layout.preview_text(big)


@pytest.mark.parametrize(("degrees", "size", "cuts"), [([3, 2, 2, 2, 1], 5, [0, 2, 5]), ([9, 1, 1], 4, [0, 1, 3]), ([1, 9, 1], 4, [0, 1, 2, 3]), ([], 4, [0, 0])])
def test_row_blocks(spark, degrees, size, cuts):
    rows = spark.createDataFrame(list(enumerate(degrees)), "id long, out_degree long")
    assert [r.first_row for r in layout.row_blocks(rows, size).orderBy("block").collect()] == cuts


def test_bfs(spark):
    g = simple(spark)
    assert column(levels(g)) == {0: 1, 1: 2, 2: 2, 3: 2, 4: 3}
    small = Graph.of(edges(spark, SMALL))
    assert column(distances(small, 1, directed=False)) == SMALL_DISTANCES
    assert column(bfs(small, 1)) == {1: 0, 5: 1, 3: 2, 4: 3}
    lonely = Graph.of(edges(spark, [(0, 1)]), num_nodes=4)
    assert column(levels(lonely)) == {0: 1, 1: 2, 2: 0, 3: 0}
    assert unreached(lonely).first()[0] == 2
    assert column(levels(lonely, 9)) == dict.fromkeys(range(4), 0)


def test_bfs_chain_merges_rounds(spark):
    n = 12
    assert column(bfs(Graph.of(edges(spark, [(i, i + 1) for i in range(n)])))) == {i: i for i in range(n + 1)}


def test_pagerank(spark):
    g = simple(spark)
    stats = RunStats()
    got = column(pagerank(g, stats=stats))
    assert got == pytest.approx(dict(enumerate(SIMPLE_RANKS)), abs=2e-6)
    assert stats.scalars["converged"] and stats.series["delta"][-1] < 1e-6
    assert column(residual_pagerank(g)) == pytest.approx(got, abs=1e-5)
    assert column(residual_pagerank(g, integers=True)) == pytest.approx(got, abs=1e-5)
    assert [r.id for r in top_ranked(pagerank(g, rounds=30), 2).collect()] == [3, 2]
    moves = [r.delta for r in deltas(g, 4).orderBy("round").collect()]
    assert moves == sorted(moves, reverse=True)


def test_residual_reads_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def over(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    g = Graph.of(edges(spark, SIMPLE).mapInArrow(over, "src long, dst long"))
    assert residual_pagerank(g, rounds=1).count() == 5
    assert read.value == len(SIMPLE)


def test_residual_of_a_block_is_one_round(spark):
    stats = RunStats()
    assert column(residual_pagerank(simple(spark), epsilon=1e-7, stats=stats)) == pytest.approx(dict(enumerate(SIMPLE_RANKS)), abs=1e-6)
    assert stats.scalars["iterations"] == 1 and stats.series["wl_size"] == [0]


def plain_ranks(pairs_, ids):
    """Ranks by dense sweeps, not normalized; an edge to no vertex counts for its source's degree."""
    of = {v: i for i, v in enumerate(ids)}
    degree = np.bincount([of[a] for a, _ in pairs_ if a in of], minlength=len(ids))
    kept = [(of[a], of[b]) for a, b in pairs_ if a in of and b in of]
    src, dst = np.array(kept).T
    r = np.full(len(ids), 0.15)
    for _ in range(200):
        r = 0.15 + 0.85 * np.bincount(dst, r[src] / degree[src], len(ids))
    return dict(zip(ids, r))


@pytest.mark.parametrize("block", [30, 2000])
def test_residual_in_blocks(spark, monkeypatch, block):
    # two hubs, parallel edges, self-loops, sinks, negative ids, ends and sources that are no vertices
    pairs_ = [(0, i) for i in range(1, 120)] + [(-7, i * 3) for i in range(60)] + [(i, i * 7 % 90 - 10) for i in range(-10, 120)] + [(5, 5), (5, 5), (5, 6), (119, 500), (119, -7), (700, 3), (20, 0)]
    monkeypatch.setattr(pagerank_module.blocks, "BLOCK", block)
    stats = RunStats()
    ids = list(range(-10, 121))
    vertices = spark.createDataFrame([(i,) for i in ids], "id long")
    got = column(residual_pagerank(Graph.of(edges(spark, pairs_), vertices), epsilon=1e-5, normalized=False, stats=stats))
    assert got == pytest.approx(plain_ranks(pairs_, ids), abs=1e-3)
    assert (stats.scalars["iterations"] == 1) == (block == 2000)


def test_residual_of_odd_graphs(spark):
    assert column(residual_pagerank(Graph.of(edges(spark, [])), normalized=False)) == {}
    assert column(residual_pagerank(Graph.of(edges(spark, []), num_nodes=3), normalized=False)) == pytest.approx(dict.fromkeys(range(3), 0.15))
    # a null end is a vertex that no edge meets, and counts for the shares of its source
    got = column(residual_pagerank(Graph.of(edges(spark, [(1, 2), (1, None), (None, 2), (2, 2)])), epsilon=1e-9, normalized=False))
    assert got == pytest.approx({1: 0.15, 2: (0.15 + 0.85 * 0.15 / 2) / 0.15, None: 0.15}, abs=1e-6)


def test_pagerank_of_sweeps(spark):
    g = Graph.of(edges(spark, SMALL))
    for directed, want in ((True, SMALL_DIRECTED), (False, SMALL_UNDIRECTED)):
        raw = column(pagerank(g, directed=directed, normalized=False))
        assert {k: v / 5 for k, v in raw.items()} == pytest.approx(want, abs=5e-5)


def numbers(text, sep=" ", kind=int):
    return [(int(a), kind(b)) for a, b in (x.split(sep) for x in text.split(";"))]


def test_golden_graphs(spark):
    g = Graph.of(edges(spark, numbers(TWENTY)))
    assert column(distances(g, 1, directed=False)) == dict(numbers(TWENTY_DISTANCES))
    raw = column(pagerank(g, normalized=False))
    assert {k: v / 20 for k, v in raw.items()} == pytest.approx(dict(numbers(TWENTY_RANKS, ":", float)), abs=5e-5)
    found = column(levels(Graph.of(edges(spark, numbers(HUNDRED))), 1, directed=False))
    assert len(found) == 100 and sum(v > 0 for v in found.values()) == 79 and max(found.values()) == 21


def test_hubs_are_dealt_apart(spark):
    pairs_ = [(0, i) for i in range(1, 3001)] + [(i, i + 1) for i in range(1, 400)] + [(3000, 0)]
    g = Graph.of(edges(spark, pairs_))
    dealt = deal(g.edges, least=500)
    sizes = [r.n for part in (dealt.light, dealt.heavy) for r in part.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt.hubs.count() == 1 and max(sizes) <= 2 * len(pairs_) / tasks and sum(sizes) == len(pairs_)
    met = dealt.join(spark.createDataFrame([(0,), (5,)], "src long"))
    assert met.count() == 3001
    assert deal(g.edges).heavy is None


def test_hub_queries_equal_those_without(spark, monkeypatch):
    pairs_ = [(0, i) for i in range(1, 600)] + [(i, i * 7 % 300) for i in range(1, 600)] + [(599, 700), (700, 701)]
    g = Graph.of(edges(spark, pairs_))
    plain = column(bfs(g, 0)), column(pagerank(g, rounds=7)), column(pagerank(g))
    for module in (bfs_module, pagerank_module):
        monkeypatch.setattr(module, "deal", lambda e: deal(e, least=100))
    assert column(bfs(g, 0)) == plain[0] and column(pagerank(g, rounds=7)) == pytest.approx(plain[1]) and column(pagerank(g)) == pytest.approx(plain[2])
    monkeypatch.setattr(bfs_module, "THIN", 0)
    assert column(bfs(g, 0)) == plain[0]


def test_pagerank_arguments(spark):
    for bad in ({"alpha": 1.5}, {"epsilon": 0.0}):
        with pytest.raises(ValueError):
            pagerank(simple(spark), **bad)


def test_empty_graph(spark):
    g = Graph.of(edges(spark, []))
    assert g.summary().first().asDict() == {"num_nodes": 0, "num_edges": 0, "max_outdegree": 0}
    assert pagerank(g, rounds=1).count() == 0 and levels(g).count() == 0 and g.csr_offsets().count() == 0


def test_text(spark, tmp_path):
    (tmp_path / "g.txt").write_text("\n 5 10\n" + "\n".join(f"{a}  {b} " for a, b in SIMPLE) + "\n\n")
    g = load(spark, str(tmp_path / "g.txt"))
    assert g.header == (5, 10) and pairs(g.edges) == sorted(SIMPLE) and g.num_nodes() == 5
    (tmp_path / "same.txt").write_text("2 1\n2 1\n")
    assert pairs(read_edge_list(spark, str(tmp_path / "same.txt")).edges) == [(2, 1)]
    with pytest.raises(ValueError):
        read_edge_list(spark, str(tmp_path / "same.txt"), validate=True)
    (tmp_path / "bad.txt").write_text("\n")
    with pytest.raises(ValueError):
        load(spark, str(tmp_path / "bad.txt"))
    with pytest.raises(ValueError):
        load(spark, "graph.TXT")
    (tmp_path / "plain").write_text("1 5\n2 4\n")
    assert pairs(read_edge_list(spark, str(tmp_path / "plain"), header="none").edges) == [(1, 5), (2, 4)]
    (tmp_path / "gold").write_text('"1" 5\n1 5\n5 3\n')
    found, ids = read_golden_list(spark, str(tmp_path / "gold"), directed=False)
    assert pairs(found) == [("1", "5"), ("3", "5"), ("5", "1"), ("5", "3")] and ids.count() == 3
    assert spark.range(1).select(digits(F.lit("a1b2"))).first()[0] == 12


@pytest.mark.parametrize("version", [1, 2])
def test_binary(spark, tmp_path, version):
    path = str(tmp_path / "g.gr")
    write_binary(simple(spark), path, version)
    for per_task in (2, 1 << 20):
        g = read_binary(spark, path, nodes_per_task=per_task, edges_per_batch=3)
        assert g.header == (5, 10) and pairs(g.edges) == sorted(SIMPLE) and g.num_nodes() == 5
    whole = open(path, "rb").read()
    for bad in (whole[:16], whole[:50], b"\x07" + whole[1:]):
        (tmp_path / "bad.gr").write_bytes(bad)
        with pytest.raises(ValueError):
            load(spark, str(tmp_path / "bad.gr"))


def test_binary_of_many_pieces(spark, tmp_path):
    g = uniform_graph(spark, 3000, 8, seed=2)
    g = type(g).of(g.edges, num_nodes=3100)  # the last vertices have no edges
    for version in (1, 2):
        path = f"file://{tmp_path}/v{version}.gr"
        write_binary(g, path, version, chunk=1000)
        back = read_binary(spark, path, nodes_per_task=700)
        assert pairs(back.edges) == pairs(g.edges) and back.num_nodes() == 3100
        raw = np.fromfile(f"{tmp_path}/v{version}.gr", np.uint8)
        ends = raw[32 : 32 + 8 * 3100].view("<u8").astype(int)
        dst = raw[32 + 8 * 3100 :].view("<u4" if version == 1 else "<u8").astype(int)
        assert [(i, d) for i, (a, b) in enumerate(zip([0, *ends], ends)) for d in dst[a:b]] == pairs(g.edges)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v1.gr", "v2.gr"]
    with pytest.raises(ValueError):
        write_binary(type(g).of(g.edges.selectExpr("src + 1 AS src", "dst + 1 AS dst")), str(tmp_path / "x.gr"))
    none = type(g).of(g.edges.limit(0), num_nodes=4)
    write_binary(none, str(tmp_path / "none.gr"))
    assert load(spark, str(tmp_path / "none.gr")).num_nodes() == 4


def test_generators(spark):
    assert complete_graph(spark, 6).num_edges() == 15
    for g in (uniform_graph(spark, 40, 3, seed=1), focus_graph(spark, 40, 4, seed=1)):
        got = pairs(g.edges)
        assert got and all(a != b for a, b in got) and len({frozenset(e) for e in got}) == len(got)
        assert got == pairs(g.edges)
    near = uniform_graph(spark, 40, 3, seed=1).symmetrize()
    found = column(levels(near))
    assert all(abs(found[a] - found[b]) <= 1 for a, b in pairs(near.edges) if found[a])
    assert sum(column(pagerank(near, rounds=20)).values()) == pytest.approx(1)


def test_lines(spark):
    assert bfs_lines(spark.createDataFrame([(7, 2)], "id long, distance int")).first()[0] == "7 2"
    assert rank_lines(spark.createDataFrame([(7, 0.25)], "id long, rank double")).first()[0] == "7".ljust(30) + " :" + "0.25".ljust(10)


def test_stats(spark, tmp_path):
    ticks = iter([0.0, 2.0, 5.0, 6.0])
    s = RunStats(lambda: next(ticks))
    s.start()
    s.start()
    s.checkpoint("load")
    s.checkpoint("pagerank")
    s.add_stat("iterations", 1)
    s.add_stat("iterations", 3)
    s.add_datapoint("wl_size", 4)
    s.json_dump(str(tmp_path / "s.json"))
    s.stop()
    assert json.loads((tmp_path / "s.json").read_text()) == {"iterations": 3, "load": 2.0, "pagerank": 3.0, "total": 6.0, "wl_size": [4]}
    assert s.frame(spark).first().series == {"wl_size": [4.0]}


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 30
