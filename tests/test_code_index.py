import json
import random

import pytest
from pyspark.sql import functions as F

from skein import config
from skein.extract.symbols import extract
from skein.functions import text
from skein.functions.vectors import cosine
from skein.operators import budget, changes, graph, relevance, resolve, store
from skein.sources import corpus, ignore


@pytest.mark.parametrize(
    "pattern, path, hit",
    [
        ("dist/", "a/dist/b/c.ts", True), ("dist/", "dist/c.ts", True), ("dist/", "distance/c.ts", False), ("**/gen/**", "gen/x.ts", True), ("*.min.js", "a/b/x.min.js", True), ("*.min.js", "a/x.min.jsx", False),
        ("src/ui/*.ts", "p/src/ui/x.ts", True), ("src/ui/*.ts", "p/src/ui/v/x.ts", False), ("a?b", "b", True), ("a?b", "ab", True), ("a?b", "axb", False), ("!neg", "neg", False), ("a.b", "axb", False), ("(x)", "(x)", True),
    ],
)
def test_ignore_patterns(pattern, path, hit):
    import re

    assert bool(re.match(ignore.combined([pattern]), path)) == hit


def test_ignore_files(tmp_path):
    (tmp_path / ".gitignore").write_text("# c\n\n  logs/ \nlogs/\n")
    assert ignore.load(tmp_path)[-1] == "logs/" and ignore.load(tmp_path).count("logs/") == 1
    assert ignore.combined([]) == "(?!)"


def test_walk_keeps_odd_names(spark, tmp_path):
    for name in ("__init__.py", "_x.go", ".hidden.py", "empty.rs", "UP.TS", "no.mjs", "node_modules/a.js", "d/x.py"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_text("" if name == "empty.rs" else "x")
    names = corpus.walk(tmp_path, ["node_modules/"])
    assert names == sorted([".hidden.py", "UP.TS", "__init__.py", "_x.go", "d/x.py", "empty.rs"])
    rows = corpus.hashed(corpus.read_corpus(spark, tmp_path, ["node_modules/"])).collect()
    assert {r.path for r in rows} == set(names) and {len(r.hash) for r in rows} == {64}


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"graph": {"max_depth": 3}, "ignore": ["a"], "other": 1}))
    c = config.load(tmp_path / "c.json")
    assert c.graph.max_depth == 3 and c.relevance.threshold == 0.45 and c.ignore == ("a",)
    config.save(c, tmp_path / "d.json")
    assert config.load(tmp_path / "d.json") == c
    (tmp_path / "bad.json").write_text("{")
    with pytest.warns(UserWarning):
        assert config.load(tmp_path / "bad.json") == config.Config()
    o = tmp_path / "o.json"
    config.add_override(o, "include", ["a", "b"])
    assert config.add_override(o, "exclude", ["a"]) == {"include": ["b"], "exclude": ["a"]}
    config.clear_overrides(o)
    assert config.load_overrides(o) == {"include": [], "exclude": []}


def test_text_columns(spark):
    row = spark.range(1).select(
        text.token_estimate(F.lit("a😀")).alias("t"), text.token_estimate(F.lit(None).cast("string")).alias("n"), text.round_half_up(F.lit(-2.5)).alias("r"), text.extension(F.lit("a/.env")).alias("e"),
        text.extension(F.lit("a/b.TSX")).alias("x"), text.squeeze(F.lit(" a \n b ")).alias("s"), text.directories(F.lit("a/b/c.ts")).alias("d"), text.node_label(F.lit("x" * 40)).alias("l"), text.relative_to(F.lit("/r/a/b"), "/r").alias("p"),
        text.age_label(F.lit("2025-01-01").cast("timestamp"), F.lit("2025-01-03").cast("timestamp")).alias("age"), text.bar(F.lit(1), F.lit(4), 8).alias("bar"),
    ).first()
    assert (row.t, row.n, row.r, row.e, row.x, row.s, row.d, row.p, row.age) == (1, 0, -2, "", ".tsx", "a b", ["a", "a/b"], "a/b", "2d ago")
    assert row.l == "..." + "x" * 25 and row.bar == "██░░░░░░"


def test_cosine(frame):
    got = [r.c for r in frame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>").select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert abs(got[0] - 0.70710678) < 1e-6 and got[1:] == [0.0, None, None]


def test_changes(frame):
    disk = frame([("a", "1"), ("b", "2"), ("n", "3"), ("z", None)], "path string, hash string")
    index = frame([("a", "1"), ("b", "x"), ("gone", "4"), ("z", None)], "path string, hash string")
    assert {tuple(r) for r in changes.changed_by_hash(disk, index).collect()} == {("b", "changed"), ("n", "new")}
    assert [r.path for r in changes.missing_on_disk(disk, index).collect()] == ["gone"]
    assert {tuple(r) for r in changes.repair_plan(disk, index).collect()} == {("a", "keep"), ("b", "reindex"), ("gone", "delete"), ("z", "keep")}
    none = frame([], "path string")
    assert changes.choose_changes(none, False, disk, index)[1] == "hash" and changes.choose_changes(none, True, disk, index)[1] == "hybrid"
    assert changes.choose_changes(frame([("a",), ("nofile",)], "path string"), True, disk, index)[1] == "git"


def test_walk_is_shortest_and_hubs_count_once(frame):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for _ in range(40)]
    near = {}
    both = edges + [(b, a) for a, b in edges]
    layer, d = {"n0"}, 0
    while layer and d <= 3:
        near |= {n: d for n in layer}
        layer, d = {b for a, b in both if a in layer and b not in near}, d + 1
    got = {r.path: r.depth for r in graph.neighbourhood(frame(edges, "from_path string, to_path string"), frame([("n0",)], "path string"), 3).collect()}
    assert got == near


def test_tree_listing(frame):
    e = frame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "from_path string, to_path string")
    assert graph.tree_listing(e, "a", 3) == [(0, "a", False), (1, "b", False), (2, "d", False), (3, "a", True), (1, "c", False), (2, "d", True)]


def test_resolution_order(frame):
    imports = frame([("p/a.ts", "./b"), ("p/a.ts", "./c.js"), ("p/a.ts", "../q"), ("p/a.ts", "./none"), ("p/a.ts", "node:fs"), ("p/a.ts", "@w/core/x"), ("p/a.ts", "core")], "from_path string, source string")
    files = frame([(x,) for x in ("p/b.tsx", "p/b.ts", "p/c.ts", "p/c.js", "q/index.js", "packages/core/src/x.ts", "packages/core/main.ts")], "path string")
    got = {r.source: r.to_path for r in resolve.resolve_relative(imports, files).collect()}
    assert got == {"./b": "p/b.ts", "./c.js": "p/c.js", "../q": "q/index.js"}
    packages = frame([("@w/core", "packages/core/src", "main.js")], "name string, src_dir string, main string")
    assert {r.source: r.to_path for r in resolve.resolve_workspace(imports, packages, files).collect()} == {"@w/core/x": "packages/core/src/x.ts", "core": "packages/core/main.ts"}


def test_fusion_closed_form(frame):
    walked = frame([("c", 0), ("t", 1), ("u", 1), ("a", 2), ("b", 2), ("far", 3)], "path string, depth int")
    similar = frame([("u", 0.46), ("a", 0.45)], "path string, score double")
    got = {r.path: (round(r.final, 3), r.included) for r in relevance.score(walked, similar).collect()}
    assert got == {"c": (1.0, True), "t": (0.68, True), "u": (0.664, True), "a": (0.48, True), "b": (0.42, False)}
    assert [r.path for r in relevance.rank(relevance.score(walked, similar)).where("bucket = 'touched'").orderBy("rank").collect()] == ["t", "u"]


def test_escalation_and_savings(frame):
    got = [r.b for r in frame([(4,), (5,), (9,), (10,)], "n int").select(budget.escalated(F.lit(2000), F.col("n")).alias("b")).collect()]
    assert got == [2000, 4000, 4000, 8000]
    rows = frame([(200, 205), (0, 0), (1000, 300)], "raw long, opt long").select(*budget.savings(F.col("raw"), F.col("opt"))).collect()
    assert [tuple(r) for r in rows] == [(-5, -2, 1.0), (0, 0, 1.0), (700, 70, 3.3)]


def test_first_fit_passes_over(frame):
    items = frame([("a", 1, 50), ("b", 2, 80), ("c", 3, 40)], "path string, rank int, cost int")
    assert {r.path for r in budget.first_fit(items, 100).collect()} == {"a", "c"}
    assert budget.first_fit(items, -5).count() == 0


def test_first_fit_in_groups_equals_one_after_the_other(frame):
    rnd = random.Random(8)
    rows = [(g, f"p{i:03}", i, rnd.choice([0, 1, 1, 2, 3, 7, 7, 30, 200, None])) for g in (1, 2) for i in range(150)]
    want = set()
    for g, room in ((1, 60), (2, 17)):
        left = room
        for _, p, _, c in [r for r in rows if r[0] == g]:
            if c is not None and c <= left:
                left -= c
                want.add((g, p))
    items = frame(rows, "g int, path string, rank int, cost int").withColumn("room", F.when(F.col("g") == 1, 60).otherwise(17))
    assert {(r.g, r.path) for r in budget.first_fit(items, F.col("room"), group=["g"]).collect()} == want


def test_ranks_over_ranges(frame):
    rnd = random.Random(2)
    rows = [("ab"[rnd.randrange(2)], rnd.randrange(5), f"p{i}") for i in range(300)]
    got = {r.path: r.rank for r in relevance.ranked(frame(rows, "bucket string, final int, path string"), "bucket", [F.col("final").desc(), F.col("path")]).collect()}
    for b in "ab":
        assert [got[p] for _, _, p in sorted((r for r in rows if r[0] == b), key=lambda r: (-r[1], r[2]))] == list(range(1, sum(r[0] == b for r in rows) + 1))


def test_the_skeleton_counts_in_the_cascade(frame):
    files = frame([("c", "changed", 1, 100, 9, 9), ("t", "touched", 1, 500, 80, 10), ("a", "ancestor", 1, 500, 70, 20)], "path string, bucket string, rank int, full int, symbols int, summary int")
    for limit, levels, left_out in [(300, ["symbols", "summary"], False), (230, ["summary", "summary"], False), (200, ["summary", "excluded"], False), (150, ["summary", "excluded"], True), (105, ["excluded", "excluded"], True)]:
        for skeleton in (90, frame([(90,)], "n int")):
            got = {r.path: (r.level, r.no_skeleton) for r in budget.cascade(files, frame([(limit,)], "budget int"), 0, skeleton).collect()}
            assert [got["t"][0], got["a"][0]] == levels and {x[1] for x in got.values()} == {left_out}, limit


def test_notices_and_tokens(spark, tmp_path):
    from skein.functions.tokens import bpe_tokens

    assert budget.escalation_notice(2000, 2000, 3) == "" and "4,000" in budget.escalation_notice(2000, 4000, 5)
    assert ignore.write_template(tmp_path) and not ignore.write_template(tmp_path) and "dist/" in ignore.load(tmp_path)
    df = spark.createDataFrame([("Hello world, hello",), ("",), (None,), ("<|endoftext|>",)], "t string")
    pytest.importorskip("tiktoken")
    got = [r.n for r in df.select(bpe_tokens()(F.col("t")).alias("n")).collect()]
    assert got[0] == 4 and got[1:3] == [0, 0] and got[3] > 1
    assert [r.n for r in df.select(bpe_tokens("/none")(F.col("t")).alias("n")).collect()][:3] == [5, 0, 0]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace as N

    from skein.session import shared_folder

    spark = lambda master, folder: N(sparkContext=N(master=master, applicationId="x", getConf=lambda: N(get=lambda _: folder)))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(spark(master, None))
    assert shared_folder(spark("local[4]", None)).endswith("/skein-x") and shared_folder(spark("yarn", "hdfs:///c/")) == "hdfs:///c/skein-x"


@pytest.mark.parametrize("limit, levels", [(1000, "symbols symbols summary"), (259, "summary summary summary"), (150, "summary summary summary"), (149, "summary summary excluded"), (129, "summary excluded excluded"), (99, "excluded excluded excluded")])
def test_cascade_at_the_limits(frame, limit, levels):
    files = frame([("c", "changed", 1, 100, 9, 9), ("t1", "touched", 1, 500, 80, 10), ("t2", "touched", 2, 500, 60, 20), ("a", "ancestor", 1, 500, 70, 20)], "path string, bucket string, rank int, full int, symbols int, summary int")
    got = {r.path: r.level for r in budget.cascade(files, frame([(limit,)], "budget int")).collect()}
    assert got["c"] == "full"
    assert f"{got['t1']} {got['t2']} {got['a']}" == levels


def test_upsert_then_delete_is_identity(frame):
    base = frame([("a", "1"), ("b", "2")], "path string, hash string")
    up = store.upsert(base, frame([("b", "3"), ("c", "4")], "path string, hash string"), ["path"])
    assert {tuple(r) for r in up.collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    assert {r.path for r in store.delete(up, frame([("b",), ("c",)], "path string"), "path").collect()} == {"a"}


@pytest.mark.parametrize(
    "language, source, functions, classes, types, exports, imports",
    [
        ("typescript", "import a, {b as c} from './x.js';\nexport async function f(x: number): string { return `}`; }\nconst g = (y) => 1;\nclass K extends B { private m(): void {} }\nexport interface I { a: 1 }\nexport const N = 3;\nexport { g };", ["f", "g"], ["K"], ["I"], ["f", "g", "I"], ["./x.js"]),
        ("python", "import os, sys\nfrom m import x\nclass C(B):\n    async def run(self) -> int:\n        pass\ndef _p(): pass\n", ["run", "_p"], ["C"], [], ["run"], ["os", "sys", "m"]),
        ("go", 'package p\nimport (\n "fmt"\n x "y/z"\n)\nfunc (t T) Up(a int) error {}\nfunc low() {}\ntype S struct {}\n', ["Up", "low"], [], ["S"], ["Up", "S"], ["fmt", "y/z"]),
        ("rust", "use a::{b, c};\npub async fn f<T>(x: T) -> i32 { 1 }\nfn g() {}\npub(crate) enum E {}\n", ["f", "g"], [], ["E"], ["f", "E"], ["a::{b, c}"]),
        ("java", "package p;\nimport java.util.List;\npublic class K extends B { private int f(int a) { return new X(a); } class N { void g() {} } }\n", ["f", "g"], ["K", "N"], ["K", "N"], ["K", "N"], ["java.util.List"]),
    ],
)
def test_symbols(language, source, functions, classes, types, exports, imports):
    s = extract(source, language)
    names = lambda k, f="name": [x[f] for x in s[k]]
    assert names("functions") == functions and names("classes") == classes and names("types") == types and names("exports") == exports and names("imports", "source") == imports


def test_symbols_of_broken_sources():
    assert extract("class A { f( {", "java") is not None and extract(None, "go") is None and extract("x", "cobol") is None


def test_engine_end_to_end(spark, tmp_path):
    from skein.engine import Engine

    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.ts").write_text("import { b } from './b';\nexport function a(): number { return b(); }\n")
    (root / "b.ts").write_text("export function b(): number { return 1; }\n")
    (root / "c.py").write_text("def c(): pass\n")
    e = Engine(spark, str(root))
    e.build_index()
    assert e.store.version == 2 and e.run_task("nothing") is None
    assert [(r.from_path, r.to_path) for r in e.store.read("graph_edges").collect()] == [("a.ts", "b.ts")]
    (root / "b.ts").write_text("export function b(): number { return 2; }\n")
    x = e.run_task("change b", 500, record="s1")
    assert {r.path: r.level for r in x.manifest.collect()} == {"b.ts": "full", "a.ts": "symbols"} and "TASK: change b" in x.text
    assert e.stats()["totals"].first().files == 3 and "1 tasks" in e.report("2000-01-01")
    assert x.notice == "" and {r.reason for r in x.manifest.collect()} >= {"directly changed"}
    assert e.importers("b.ts") == "imports 0, imported by 1\n  a.ts"
    edge = e.store.read("graph_edges").first().recorded_at
    (root / "c.py").unlink()
    assert dict(e.repair()) == {"delete": 1, "keep": 1, "reindex": 1}
    assert {r.path for r in e.store.read("indexed_files").collect()} == {"a.ts", "b.ts"}
    assert e.dependency_tree("a.ts") == "a.ts\n  b.ts" and e.graph_svg("a.ts").count("<rect") == 2
    assert e.store.read("graph_edges").first().recorded_at == edge  # an edge of a file that was not indexed again keeps its time


def test_events_are_followed_across_batches(spark, tmp_path):
    """A late older event changes nothing; a changed file gets its rows, symbols and edges; a removed one goes."""
    from datetime import datetime as D

    from skein.engine import Engine

    root, feed = tmp_path / "repo", tmp_path / "feed"
    root.mkdir()
    for name in "abc":
        (root / f"{name}.ts").write_text(f"export const {name} = 1;\n")
    e = Engine(spark, str(root))
    e.build_index()
    schema = "type string, path string, ts timestamp"

    def follow(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(feed))
        e.start_stream(spark.readStream.schema(schema).parquet(str(feed)), str(tmp_path / "log")).awaitTermination()

    (root / "a.ts").write_text("import { b } from './b';\nexport function a() { return b; }\n")
    follow(("updated", "a.ts", D(2025, 1, 5)), ("removed", "c.ts", D(2025, 1, 5)), ("added", "c.ts", D(2025, 1, 4)))
    assert {r.path for r in e.store.read("indexed_files").collect()} == {"a.ts", "b.ts"}
    assert [(r.from_path, r.to_path) for r in e.store.read("graph_edges").collect()] == [("a.ts", "b.ts")]
    follow(("removed", "a.ts", D(2025, 1, 3)), ("added", "c.ts", D(2025, 1, 6)))
    assert {r.path for r in e.store.read("indexed_files").collect()} == {"a.ts", "b.ts", "c.ts"}
    assert {r.path: r.ts.day for r in e.store.read("watch_state").collect()} == {"a.ts": 5, "c.ts": 6}


def test_git_changes_are_named_as_they_are(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "sub" / "packages").mkdir(parents=True)
    for name in ("sub/größe.ts", "sub/b.ts", "top.ts", "sub/packages/p.ts"):
        (tmp_path / name).write_text("1")
    git("add", "-A")
    git("commit", "-qm", "x")
    for name in ("sub/größe.ts", "top.ts", "sub/packages/p.ts", "sub/new.py"):
        (tmp_path / name).write_text("2")
    df, is_repository = corpus.git_changes(spark, tmp_path / "sub")
    assert is_repository and {r.path for r in df.collect()} == {"größe.ts", "new.py"}
