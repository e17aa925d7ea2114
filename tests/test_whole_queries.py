from conftest import SMALL

from factloom.operators import graph, resolve, traverse
from factloom.plans import catalog
from factloom.sources.collections import collection


def test_components_of_all_edges(spark):
    ids = [r.id for r in collection(spark, SMALL, "nodes").collect()]
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for e in collection(spark, SMALL, "edges").where("kind <> 'contains'").collect():
        if e.src in up and e.dst in up:
            a, b = sorted((top(e.src), top(e.dst)))
            up[b] = a
    want = {i: top(i) for i in ids}
    got = {r.id: r.component for r in catalog.QUERIES["connected_components"](spark, SMALL).collect()}
    assert got == want
    sizes = [list(want.values()).count(c) for c in set(want.values())]
    row = catalog.QUERIES["component_summary"](spark, SMALL).first()
    assert (row.component_count, row.largest_component_size, row.singleton_count) == (len(sizes), max(sizes), sizes.count(1))


def test_walk_order_of_the_whole_tree(spark):
    files = collection(spark, SMALL, "files").select("path")

    def key(path):
        *above, name = path.split("/")
        return [*(f"1{p}" for p in above), f"0{name}"]

    want = {p: n for n, p in enumerate(sorted((r.path for r in files.collect()), key=key), 1)}
    assert len({p.split("/")[0] for p in want}) > 2
    for got in (catalog.QUERIES["walk_order"](spark, SMALL), traverse.walk_order(files, 7)):
        assert {r.path: r.nth for r in got.collect()} == want
    top = spark.createDataFrame([("b/a",), ("z",), ("a/x/y",), ("a/z",), ("a",)], "path string")
    assert [r.path for r in traverse.walk_order(top, 3).orderBy("nth").collect()] == ["a", "z", "a/z", "a/x/y", "b/a"]
    assert traverse.walk_order(top.limit(0)).count() == 0


def _nodes_edges(spark, links, more=()):
    ids = sorted({i for e in links for i in e} | set(more))
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    edges = spark.createDataFrame([(f"e{n}", "calls", a, b) for n, (a, b) in enumerate(links)], "id string, kind string, src string, dst string")
    return nodes, edges


def test_components_contract_long_paths_and_stars_in_few_rounds(spark, monkeypatch):
    """A path in the order of its ids, a star whose centre is the largest, pairs, and nodes alone; alternating stars needed twice the rounds."""
    name = lambda i: f"n{i:05}"
    links = [(name(i), name(i + 1)) for i in range(600)] + [("z", name(2000 + i)) for i in range(200)] + [("x", "x"), ("y", "w"), ("w", "y")]
    nodes, edges = _nodes_edges(spark, links, ["alone"])
    written, measured = [], traverse.measured
    monkeypatch.setattr(traverse, "measured", lambda df: written.append(df) or measured(df))
    got = {r.id: r.component for r in traverse.components(nodes, edges).collect()}
    want = {name(i): name(0) for i in range(601)} | {name(2000 + i): name(2000) for i in range(200)} | {"z": name(2000), "x": "x", "y": "w", "w": "w", "alone": "alone"}
    assert got == want
    assert len(written) <= 24
    empty = traverse.components(nodes, edges.limit(0))
    assert {r.id for r in empty.where("id = component").collect()} == set(want)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _wide(spark, rows, schema):
    """A table whose size the optimizer does not know and takes for large."""
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), schema)


def test_traversal_does_not_shuffle_edges_for_a_small_frontier(spark):
    nodes = _wide(spark, [(i,) for i in "abcd"], "id string")
    edges = _wide(spark, [(f"e{a}{b}", "calls", "PROVEN", a, b) for a, b in ("ab", "bc", "cd")], "id string, kind string, confidence string, src string, dst string")
    near, met = traverse.subgraph(nodes, edges, nodes.where("id = 'a'"), depth=2, direction="both")
    assert "BroadcastHashJoin" in _plan(met) and "SortMergeJoin" not in _plan(met)
    assert ({r.id for r in near.collect()}, {r.id for r in met.collect()}) == ({"a", "b", "c"}, {"eab", "ebc"})


def test_missing_endpoints_look_each_end_up_once(spark):
    nodes = _wide(spark, [("a",), ("a",), ("b",)], "id string")
    rows = [("1", "k", "a", "b"), ("2", "k", "a", "x"), ("3", "k", "y", "b"), ("4", "k", "y", "x"), ("4", "k", "y", "x"), ("5", "k", None, "b")]
    lost = graph.missing_endpoints(_wide(spark, rows, "id string, kind string, src string, dst string"), nodes)
    assert _plan(lost).count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in _plan(lost)
    assert sorted(r.id for r in lost.collect()) == ["2", "3", "4", "5"]


def test_hubs_are_broadcast(spark):
    nodes = _wide(spark, [("f1", "file", "f1", "1"), ("f2", "file", "f2", "2"), ("r", "role", "r", None)], "id string, kind string, label string, source_path string")
    edges = _wide(spark, [("1", "categorized_as", "f1", "r"), ("2", "belongs_to", "f1", "r"), ("3", "calls", "f2", "r")], "id string, kind string, src string, dst string")
    found = graph.hub_files(nodes, edges, ("role",), 8)
    assert "BroadcastHashJoin" in _plan(found)
    assert [(r.source_path, r.rank, r.degree, r.reasons) for r in found.orderBy("rank").collect()] == [("1", 1, 2, "belongs_to,categorized_as"), ("2", 2, 1, "calls")]


def test_edge_links_keep_every_id_and_pack_hashed_ones(spark):
    ids = ["edge:" + "0a" * 12, "edge:" + "0A" * 12, "edge:" + "0a" * 12 + "\n", "edge:" + "0a" * 11, "edge", "", None]
    edges = _wide(spark, [(i, "calls", "a", "b") for i in ids], "id string, kind string, src string, dst string")
    links = graph.edge_links(edges, _wide(spark, [("a", "A")], "id string, label string"))
    assert "unhex" in _plan(links)
    key = lambda x: (x is None, x or "")
    assert sorted((r.id for r in links.collect()), key=key) == sorted(ids, key=key)
    assert {(r.src_label, r.dst_label) for r in links.collect()} == {("A", None)}


def test_only_distinct_bases_meet_the_inventory(spark):
    files = spark.createDataFrame([("src/ui/a.tsx",), ("src/ui/a.ts",), ("lib/b/index.js",), ("src/c.md",)], "path string")
    rows = [("src/x/m.ts", "../ui/a"), ("src/x/m.ts", "@/ui/A"), ("src/x/m.ts", "kit"), ("src/x/m.ts", "@/b"), ("src/n.ts", "./ui/a"), ("src/n.ts", "./c"), ("src/n.ts", "../../out")]
    imports = spark.createDataFrame(rows + rows[:1], "path string, module string")
    a, b = "src/ui/a.ts", "lib/b/index.js"
    for aliases, there in (([("@/*", "src/*")], None), ([("@/*", "src/*"), ("@/*", "lib/*")], b)):
        want = dict(zip(rows, [a, a, None, there, a, "src/c.md", None], strict=True))
        got = resolve.with_target(imports, files, aliases).collect()
        assert len(got) == 8 and {(r.path, r.module): r.target for r in got} == want
        assert resolve.resolved(imports, files, aliases).count() == 7
