"""Manifests, history, symbols, extraction and stores."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import relational, store
from lodestone.plans import extraction
from lodestone.schemas import TABLES
from lodestone.sources import files, manifests

MANIFESTS = {
    "go.mod": ("module x\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgithub.com/c/d v0.1.0 // indirect\n)\nrequire github.com/e/f v2.0.0\n", {("github.com/a/b", "v1.2.3", False), ("github.com/c/d", "v0.1.0", True), ("github.com/e/f", "v2.0.0", False)}),
    "package.json": ('{"dependencies": {"react": "^18"}, "devDependencies": {"jest": "29"}}', {("react", "^18", False), ("jest", "29", True)}),
    "requirements.txt": ("# no\nflask==2.0\nrequests>=1.0,<2\n-r other.txt\nnumpy\n", {("flask", "2.0", False), ("requests", "1.0", False), ("numpy", "", False)}),
    "pyproject.toml": ('[project]\ndependencies = ["httpx[http2]>=0.24; python_version>\'3\'"]\n[tool.poetry.dependencies]\npython = "^3"\nrich = {version = "13"}\n', {("httpx", "0.24", False), ("rich", "13", False)}),
    "Cargo.toml": ('[dependencies]\nserde = "1"\n[dev-dependencies]\nrand = {version = "0.8"}\n', {("serde", "1", False), ("rand", "0.8", True)}),
    "Gemfile": ("gem 'rails', '7.0'\ngem \"pg\"\n", {("rails", "7.0", False), ("pg", "", False)}),
    "pom.xml": ("<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency><dependency><groupId>j</groupId><artifactId>u</artifactId><scope>test</scope></dependency>", {("g:a", "1", False), ("j:u", "", True)}),
    "build.gradle": ("dependencies {\n implementation 'g:a:1'\n testImplementation(\"j:u:2\")\n}", {("g:a", "1", False), ("j:u", "2", True)}),
    "composer.json": ('{"require": {"php": "8", "a/b": "1"}, "require-dev": {"c/d": "2"}}', {("a/b", "1", False), ("c/d", "2", True)}),
    "pubspec.yaml": ("name: x\ndependencies:\n  flutter:\n    sdk: flutter\n  http: ^1.0\ndev_dependencies:\n  lints: 2\nother: y\n", {("http", "^1.0", False), ("lints", "2", True)}),
    "mix.exs": ('defp deps do [{:phoenix, "~> 1.7"}] end', {("phoenix", "~> 1.7", False)}),
    "Package.swift": ('.package(url: "https://h.example/o/Alamo.git", from: "5.0.0")', {("Alamo", "5.0.0", False)}),
    "App.csproj": ('<PackageReference Include="Json" Version="13" />', {("Json", "13", False)}),
}


def test_manifests(spark):
    rows = spark.createDataFrame([(f"x/{p}", bytearray(c.encode())) for p, (c, _) in MANIFESTS.items()] + [("x/broken/Cargo.toml", bytearray(b"[["))], "path string, content binary")
    got = {}
    for r in manifests.dependencies(rows).collect():
        got.setdefault(r.path.split("/")[-1], set()).add((r.name, r.version, r.dev))
    assert got == {p: want for p, (_, want) in MANIFESTS.items()}


def test_manifests_of_very_many_lines(spark):
    """A block's lines must not nest calls of the pattern matcher."""
    body = "name: x\ndependencies:\n" + "".join(f"  p{i}: ^{i}\n" + "\n" * (i % 3) for i in range(100_000)) + "dev_dependencies:\n  lints: 2\n"
    rows = spark.createDataFrame([("x/pubspec.yaml", bytearray(body.encode()))], "path string, content binary")
    got = {(r.name, r.version, r.dev) for r in manifests.pubspec_yaml(rows).collect()}
    assert got == {(f"p{i}", f"^{i}", False) for i in range(100_000)} | {("lints", "2", True)}


def test_git_log(spark, tmp_path):
    log = "COMMIT_BOUNDARY\nabc\nAnn\n2024-01-02T03:04:05+00:00\nFix it\n\nwith a body\nFILES_BOUNDARY\na.go\nb.go\nCOMMIT_BOUNDARY\ndef\nBob\nbad date\nShort\nFILES_BOUNDARY\n"
    (tmp_path / "log.txt").write_text(log)
    rows = files.read_log(spark, str(tmp_path / "log.txt")).orderBy("sha").collect()
    assert [(r.sha, r.author, r.message, r.files_changed) for r in rows] == [("abc", "Ann", "Fix it\n\nwith a body", ["a.go", "b.go"]), ("def", "Bob", "Short", [])]
    assert rows[0].date is not None and rows[1].date is None


def test_symbols_imports_calls(spark):
    lines = [{"name": "Handle", "path": "./internal/server/h.go", "kind": "func", "line": 9, "scope": "Handler"}, {"name": "Handler", "path": "./internal/server/h.go", "kind": "struct", "line": 3}, {"name": "x", "path": "a.go", "kind": "variable", "line": 1}]
    got = {r.qualified_name: r.end_line for r in files.parse_symbols(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")).collect()}
    assert got == {"server::Handler": 8, "server::Handler.Handle": None}
    go = 'package a\nimport "fmt"\nimport (\n\tx "h.example/o/util"\n)\ntype S struct {\n\tBase\n\t*pkg.Other\n\tn int\n}\nfunc (s *S) Run() {\n\tfmt.Println(s)\n\thelper(1)\n}\nfunc helper(n int) {\n}\n'
    rows = spark.createDataFrame([("a.go", bytearray(go.encode()))], "path string, content binary")
    assert {r["import"] for r in files.go_imports(rows).collect()} == {"fmt", "h.example/o/util"}
    assert {(r.caller, r.callee) for r in files.go_calls(rows).collect()} == {("S.Run", "fmt.Println"), ("S.Run", "helper")}
    assert {r.embedded for r in files.go_embeddings(rows).collect()} == {"Base", "pkg.Other"}


def test_extraction_round(spark):
    answer = '```json\n{"entities": [{"kind": "widget", "name": "A", "qualified_name": "lib/a/A"}], "facts": [{"entity_name": "A", "claim": "does", "dimension": "opinion", "category": "risk", "confidence": "very_high"}], "relationships": [{"from": "a::A", "to": "a::B", "kind": "links_to", "strength": "very_strong"}],}\n```'
    def call(path, text):
        if "bad" in path:
            raise RuntimeError("down")
        return answer
    rows = extraction.run_extractor(spark.createDataFrame([("ok.go", "x"), ("bad.go", "y")], "path string, content string"), call)
    rows = extraction.parse_payload(extraction.repaired(rows.where("error is null")))
    assert [(r.kind, r.qualified_name, r.fallbacks) for r in extraction.payload_entities(rows).collect()] == [("concept", "a::A", 1)]
    assert [(r.dimension, r.category, r.confidence, r.fallbacks) for r in extraction.payload_facts(rows).collect()] == [("what", "risk", "medium", 2)]
    assert [(r.kind, r.strength) for r in extraction.payload_relationships(rows).collect()] == [("depends_on", "moderate")]


def test_resolution_stages(spark):
    entities = spark.createDataFrame([("1", "pkg::Foo", "Foo"), ("2", "pkg::Bar", "Bar"), ("3", "other::Foo", "Foo"), ("4", "pkg::Store.Method", "Method"), ("5", "pkg::Store", "Store")], "id string, qualified_name string, name string")
    refs = spark.createDataFrame([("pkg::Foo", "x::y"), ("Store.Method", "pkg::z"), ("Unknown", "pkg::z"), ("Bar", "x::y"), ("Foo", "other::q"), ("Foo", "x::y")], "ref string, caller string")
    got = {(r.ref, r.caller): r.entity_id for r in relational.resolve_names(refs, entities).collect()}
    assert got == {("pkg::Foo", "x::y"): "1", ("Store.Method", "pkg::z"): "4", ("Bar", "x::y"): "2", ("Foo", "other::q"): "3"}


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert not s.exists("entities") and s.read("entities").count() == 0
    row = spark.createDataFrame([("e1", "r", "function", "F", "a::F")], "id string, repo_id string, kind string, name string, qualified_name string")
    full = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split(" ", 1) for f in store._fields(TABLES["entities"]))])
    s.write("entities", full(row))
    s.write("entities", store.upsert_entities(s.read("entities"), full(row.withColumn("id", F.lit("e2")).withColumn("name", F.lit("other")))))
    rows = s.read("entities").collect()
    assert [(r.id, r.name) for r in rows] == [("e1", "F")]
    assert store.check_keys("entities", s.read("entities")).count() == 0
    assert store.etag_matches('W/"abc", "x"', "abc") and store.etag_matches("*", "q") and not store.etag_matches(None, "q")


@pytest.mark.parametrize("n,want", [(None, 20), (0, 20), (-3, 20), (7, 7), (99, 50)])
def test_clamp(n, want):
    from lodestone.plans.api import clamp

    assert clamp(n, 20, 50) == want


def test_stream_queue(spark, tmp_path):
    from lodestone.streaming import changes

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"repo_id": "r", "target": t, "content_hash": h, "seen_at": "2024-01-01T00:00:00Z"}) for t, h in (("a", "1"), ("a", "1"), ("b", "2"))))
    state = {"jobs": spark.createDataFrame([("r", "a", "1", "completed")], "repo_id string, target string, content_hash string, status string")}
    def write(df):
        state["jobs"] = spark.createDataFrame(df.collect(), df.schema)
    q = changes.queue_stream(changes.file_changes(spark, str(tmp_path / "in")), lambda: state["jobs"], write, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {(r.target, r.status) for r in state["jobs"].collect()} == {("a", "completed"), ("b", "pending")}


GRAMMAR = {
    "Gemfile": (
        "source 'https://x'\n# gem 'no'\n  gem('a', '~> 1.0', '>= 1.0.2') # why\ngem \"b\",\n  '2',\n  require: false\ngem %q{c}\ngem %q(d), git: 'https://d', tag: 'v1'\ngemspec\ngem 'e', group: :test\n",
        {("a", "~> 1.0, >= 1.0.2", False), ("b", "2", False), ("c", "", False), ("d", "", False), ("e", "", False)},
    ),
    "mix.exs": (
        'defp deps do\n [\n  {:a, "~> 1.0 or ~> 2.0"},\n  # {:no, "1"},\n  {:b,\n   ">= 0.0.0",\n   only: [:dev, :test]},\n  {:c, git: "https://c", tag: "1"},\n  {:d, path: "../d"}\n ]\nend\ndef f, do: {:error, reason}\n',
        {("a", "~> 1.0 or ~> 2.0", False), ("b", ">= 0.0.0", False), ("c", "", False), ("d", "", False)},
    ),
}


def test_ruby_and_elixir_manifests_over_several_lines(spark):
    frame = spark.createDataFrame([(f"a/{k}", bytearray(text.encode())) for k, (text, _) in GRAMMAR.items()], "path string, content binary")
    got = {k: set() for k in GRAMMAR}
    for r in manifests.dependencies(frame).collect():
        got[r.source].add((r.name, r.version, r.dev))
    assert got == {k: want for k, (_, want) in GRAMMAR.items()}
