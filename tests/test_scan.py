import json
import os

import pytest
from pyspark.sql import functions as F

from factloom import cli
from factloom.plans import engine
from factloom.streaming import watch


def tree(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text) if isinstance(text, bytes) else (root / name).write_text(text)
    return root


def triples(spark, out):
    _, edges, _ = engine.load(spark, out)
    return {(r.kind, r.src, r.dst) for r in edges.collect()}


APP = {
    "README.md": "# App\n\nSee [guide](docs/guide.md).\n",
    "factloom.toml": '[import_aliases]\n"@/*" = "src/*"\n[architecture]\nfeature_markers = ["domains"]\n',
    "src/domains/Billing/screens/InvoiceScreen.tsx": 'import { Surface } from "@/components/Surface";\nimport { useThing } from "../../../hooks/useThing";\nimport Kit, { type Tool as T } from "kit";\n'
    "export function InvoiceScreen() {\n  return <Surface><Kit/></Surface>;\n}\n",
    "src/components/Surface.tsx": "export const Surface = () => null;\n",
    "src/hooks/useThing.ts": "export function useThing() {}\nconst a = 1;\nmodule.exports = a;\n",
    "pkg/service.py": "import os\nfrom .base import Base, helper as h\n\ndef deco(f):\n    return f\n\ndef helper():\n    pass\n\nclass Service(Base):\n    @deco\n    def run(self):\n        self.stop()\n        helper()\n    def stop(self):\n        pass\n",
    "pkg/base.py": "class Base:\n    pass\n",
    "app.log": "INFO start\nplain\nERROR bad INFO\ninfo again\n",
    "app.json": '{\n  "name": 1,\n  "Name": 2\n}\n',
    "img/a.png": b"\x89PNG\r\n\x1a\n",
    "package-lock.json": "{}",
    "node_modules/x/index.js": "ignored",
    ".gitignore": "secret/*.md\n!secret/keep.md\n",
    "secret/no.md": "# no\n",
    "secret/keep.md": "# Keep\n\n",
    "notes.md": "# Notes\n\nThe **Stable Graph** supports #good-methods here [x][r] and [^1].\n\n[r]: https://a.example/x \"T\"\n[^1]: a note\n",
}


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    target, out = tree(tmp_path_factory.mktemp("app"), APP), tmp_path_factory.mktemp("out") / "b"
    manifest = engine.scan(spark, target, out, engine.Options(vault=True))
    return target, out, manifest


def test_imports_definitions_and_renders(spark, bundle):
    found = triples(spark, bundle[1])
    screen = "file:src/domains/Billing/screens/InvoiceScreen.tsx"
    assert {
        ("imports", screen, "file:src/components/Surface.tsx"), ("imports", screen, "file:src/hooks/useThing.ts"), ("imports", screen, "module:kit"),
        ("imports", screen, "imported-symbol:kit#Kit"), ("exports", "module:kit", "imported-symbol:kit#T"), ("renders", screen, "file:src/components/Surface.tsx"),
        ("renders", screen, "imported-symbol:kit#Kit"), ("defines", screen, f"symbol:{screen[5:]}#InvoiceScreen:4"), ("exports", screen, f"symbol:{screen[5:]}#InvoiceScreen:4"),
        ("exports", "file:src/hooks/useThing.ts", "symbol:src/hooks/useThing.ts#a:2"), ("uses_hook", screen, "file:src/hooks/useThing.ts"), ("uses_component", screen, "file:src/components/Surface.tsx"),
        ("belongs_to", screen, "feature:Billing"), ("categorized_as", screen, "role:screen"), ("part_of", "feature:Billing", "arch:project"),
    } <= found


def test_python_relations(spark, bundle):
    found = triples(spark, bundle[1])
    p = "pkg/service.py"
    assert {
        ("imports", f"file:{p}", "file:pkg/base.py"), ("imports", f"file:{p}", "module:os"), ("contains", f"symbol:{p}#Service:10", f"symbol:{p}#Service.run:12"),
        ("depends_on", f"symbol:{p}#Service:10", "file:pkg/base.py"), ("depends_on", f"symbol:{p}#Service.run:12", f"symbol:{p}#deco:4"),
        ("calls", f"symbol:{p}#Service.run:12", f"symbol:{p}#Service.stop:15"), ("calls", f"symbol:{p}#Service.run:12", f"symbol:{p}#helper:7"),
    } <= found


def test_notes_logs_config_and_metadata(spark, bundle):
    found = triples(spark, bundle[1])
    section = "section:notes.md#notes:1"
    claim = "claim:notes.md#3:supports"
    assert {
        ("contains", "file:notes.md", section), ("mentions", section, "concept:stable-graph"), ("mentions", claim, "concept:good-methods"), ("supports", claim, section),
        ("cites", section, "reference:https://a.example/x"), ("cites", section, "reference:footnote:1"), ("references", "section:README.md#app:1", "reference:docs/guide.md"),
        ("diagnoses", "file:app.log", "log:app.log"), ("emits_log", "log:app.log", "log-statement:app.log#ERROR:3"), ("defines", "config:app.json", "config-key:app.json#name:2"),
        ("stores_asset", "file:img/a.png", "asset:img/a.png"), ("generated_from", "lockfile:package-lock.json", "file:package-lock.json"), ("contains", "dir:img", "file:img/a.png"), ("contains", "collection:target", "dir:img"),
    } <= found
    assert ("emits_log", "log:app.log", "log-statement:app.log#INFO:4") not in found
    assert not any("secret/no.md" in s + d or "node_modules" in s + d for _, s, d in found) and ("contains", "dir:secret", "file:secret/keep.md") in found


def test_verdicts_and_vault(spark, bundle):
    target, out, manifest = bundle
    assert manifest["quality"]["status"] == "passed", manifest["quality"]
    sound = engine.doctor(spark, out)
    assert sound["status"] == "passed" and sound["freshness"]["indexed_file_count"] == sound["freshness"]["current_file_count"] == manifest["quality"]["file_count"]
    q = manifest["quality"]
    assert q["nodes_by_kind"]["file"] == q["file_count"] == sum(q["content_domain_counts"].values()) and q["extractors"]["python.ast"] == 2 and q["unsupported_by_domain"] == {}
    ids = [r.id for r in engine.table(spark, out, "edges").collect()]
    assert ids == sorted(ids) and manifest["cache"]["reused"] == 0
    assert engine.status(spark, out)["freshness"] == "current"
    names = {p.relative_to(out / "vault").as_posix() for p in (out / "vault").rglob("*.md")}
    assert {"index.md", "Dashboards/Architecture.md", "Indexes/Files.md", "Files/README.md.md", "Concepts/Stable_Graph.md"} <= names
    assert len({n.lower() for n in names}) == len(names)
    seen = engine.overview(spark, out, 3)
    assert seen["warnings"] == [] and len(seen["important_files"]) == 3


def test_vault_lists_every_hub_and_its_files(spark, tmp_path):
    node = "id string, kind string, label string, source_path string, start_line int, attributes string"
    files = [(f"file:{i:02}.ts", "file", f"{i:02}.ts", f"{i:02}.ts", None, None) for i in range(11)]
    nodes = spark.createDataFrame(files + [(f"feature:{i:02}", "feature", f"F{i:02}", None, None, None) for i in range(61)], node)
    ties = [(f"file:{i:02}.ts", "feature:07", "belongs_to") for i in range(11)] + [("file:09.ts", "feature:07", "categorized_as"), ("file:10.ts", "file:09.ts", "imports"), ("file:00.ts", "feature:07", "belongs_to")]
    edges = spark.createDataFrame([(f"e{i}", *t, "DERIVED", None) for i, t in enumerate(ties)], "id string, src string, dst string, kind string, confidence string, evidence_id string")
    engine.write_vault(nodes, edges, tmp_path)
    top, more = (tmp_path / "vault/Dashboards/Features.md").read_text().split("\n\n## Top Hubs With Files\n\n")
    assert [x for x in top.splitlines() if x.startswith("- ")][0].startswith("- [[Architecture/feature/F07|F07]] (13 files)") and top.count("\n- [[") == 61
    hubs = more.split("### ")[1:]
    assert len(hubs) == 61 and hubs[1] == "[[Architecture/feature/F00|F00]] (0 linked files)\n\n- No linked files\n\n"
    first = hubs[0].strip().splitlines()
    assert first[0] == "[[Architecture/feature/F07|F07]] (11 linked files)" and len(first) == 10
    assert first[2:5] == ["- [[Files/09.ts|09.ts]] (belongs_to x1, categorized_as x1; 3 semantic edges)", "- [[Files/00.ts|00.ts]] (belongs_to x2; 2 semantic edges)", "- [[Files/10.ts|10.ts]] (belongs_to x1; 2 semantic edges)"]
    assert "- None" in (tmp_path / "vault/Dashboards/Roles.md").read_text()


def test_questions(spark, bundle):
    _, out, _ = bundle
    near = engine.query(spark, out, "feature:Billing", direction="in")
    assert "file:src/domains/Billing/screens/InvoiceScreen.tsx" in {r.id for r in near["nodes"].collect()} and near["evidence"].count() > 0
    assert engine.query(spark, out, "no such thing")["warnings"] == ["no matching node"]
    assert len(engine.query(spark, out, "md")["warnings"]) == 1
    assert {r.kind for r in engine.query(spark, out, "pkg/service.py", depth=2, direction="both", confidence=("PROVEN",))["edges"].collect()} <= {"imports", "defines", "exports", "depends_on", "calls"}
    assert [r.id for r in engine.query(spark, out, "pkg/service.py", depth=0)["nodes"].collect()] == ["file:pkg/service.py"]


def test_refresh_reuses_what_did_not_change(spark, tmp_path):
    target, out = tree(tmp_path / "t", {"a.md": "# A\n", "b.py": "def f():\n    pass\n"}), tmp_path / "o"
    engine.scan(spark, target, out)
    before = triples(spark, out)
    (target / "a.md").write_text("# Changed\n")
    assert engine.status(spark, out)["changed"] == ["a.md"]
    assert watch.watch(spark, str(out), interval=0, rounds=2, tell=lambda x: None) == 1
    kept = engine.manifest_of(out)["refresh"]
    assert (kept["mode"], kept["reused"], kept["changed"]) == ("incremental", 1, 1)
    after = triples(spark, out)
    assert ("contains", "file:a.md", "section:a.md#changed:1") in after - before and ("defines", "file:b.py", "symbol:b.py#f:1") in after
    os.remove(target / "b.py")
    assert engine.refresh(spark, out)["refresh"]["reason"] == "deleted_files"
    (out / ".ready").unlink()
    assert engine.status(spark, out)["freshness"] == "building"


def test_status_names_every_path(spark, tmp_path):
    target, out = tree(tmp_path / "t", {"a.md": "# A\n"}), tmp_path / "o"
    engine.scan(spark, target, out)
    new = {f"n/{i:04}.md": "x" for i in range(1_005)}
    tree(target, new)
    found = engine.status(spark, out)
    assert found["added"] == sorted(new) and found["counts"] == {"added": 1_005, "deleted": 0, "changed": 0}


def test_quality_of_odd_collections(spark, tmp_path):
    partial = engine.scan(spark, tree(tmp_path / "p", {"mystery.blob": "x"}), tmp_path / "po")
    assert partial["quality"]["status"] == "partial"
    plain = engine.scan(spark, tree(tmp_path / "q", {"x.go": "package x\n", "bad.py": "def (\nimport os\nclass K:\n"}), tmp_path / "qo")
    assert plain["quality"]["low_information"] == 1 and ("defines", "file:bad.py", "symbol:bad.py#K:3") in triples(spark, tmp_path / "qo")


def test_command_line_guards(spark, tmp_path, capsys):
    target = tree(tmp_path / "t", {"a.md": "# A\n"})
    assert cli.main(["scan", str(target), "--out", str(target / "out")]) == 1
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "x").write_text("mine")
    assert cli.main(["scan", str(target), "--out", str(tmp_path / "full")]) == 1
    out = str(tmp_path / "o")
    assert cli.main(["scan", str(target), "--out", out]) == 0
    assert cli.main(["scan", str(target), "--out", out]) == 1 and cli.main(["scan", str(target), "--out", out, "--replace-output"]) == 0
    assert cli.main(["doctor", out]) == 0 and cli.main(["query", out, "--node", "zzz"]) == 2
    capsys.readouterr()
    assert cli.main(["query", out, "--node", "a.md"]) == 0 and json.loads(capsys.readouterr().out)["nodes"]
    assert cli.main(["export", out]) == 0 and cli.main(["clean", out]) == 1 and cli.main(["clean", out, "--yes"]) == 0


def test_inventory_stream(spark, tmp_path):
    schema = "path string, size long, mtime_ns long, sha256 string"
    feed = tmp_path / "feed"
    rows = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(str(feed))
    for batch in ([("a", 1, 1, "x"), ("b", 1, 1, "y")], [("a", 2, 2, "z"), ("c", 1, 1, "w"), ("b", 1, 3, "y")]):
        rows(*batch)
        watch.fingerprint_stream(spark.readStream.schema(schema).parquet(str(feed)), str(tmp_path / "f"), str(tmp_path / "c")).awaitTermination()
    found = {(r.path, r.state, r.batch) for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "f/changes")).collect()}
    assert found == {("a", "added", 0), ("b", "added", 0), ("a", "changed", 1), ("c", "added", 1)}
    assert spark.read.parquet(str(tmp_path / "f/state/v1")).where(F.col("path") == "a").first().sha256 == "z"
