"""Scalar functions and pure rules against fixed cases."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import names, scoring, text
from lodestone.operators import graph, relational, store
from lodestone.plans import extraction
from lodestone.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "function,given,want",
    [
        (names.owner_of, "storage::MemoryStorage.Save", "storage::MemoryStorage"),
        (names.owner_of, "models::Task", "models"),
        (names.owner_of, "", ""),
        (names.package_of, "pkg::nested::deep", "pkg"),
        (names.package_of, "no-separator", "no-separator"),
        (names.module_name, "src/channels/registry.ts", "channels"),
        (names.module_name, "internal/storage/memory.go", "storage"),
        (names.module_name, "cmd/api/server/main.go", "api.server"),
        (names.module_name, "main.go", "main"),
        (names.dependency_name, "@scope/my-lib", "my-lib"),
        (names.normalize_name, "My_Long-Name x", "mylongnamex"),
        (names.normalize_qualified, "a/b/ c/", "b::c"),
        (names.repo_name_of_url, "git@host.example:org/thing.git", "thing"),
        (names.ignore_line, " ./build/ ", "build"),
        (names.ignore_line, "# note", None),
    ],
)
def test_names(spark, function, given, want):
    assert one(spark, function(F.lit(given))) == want


def test_tokens_and_alternatives(spark):
    assert one(spark, names.name_tokens(F.lit("parseHTTPRequest_v2"))) == ["parse", "http", "request", "v2"]
    assert one(spark, names.name_alternatives(F.lit("src::a::B"))) == ["src::a.B", "a::B"]


def test_relation_confidence(spark):
    for base, strength, want in ((0.95, "strong", 1.0), (0.01, "weak", 0.0), (0.6, "moderate", 0.6)):
        assert one(spark, scoring.relation_confidence(F.lit(base), F.lit(strength))) == pytest.approx(want)


@pytest.mark.parametrize(
    "row,want",
    [
        ((0, 0, 0, 0, 0, 0, 8, 10), {"parse_rate": 80, "overall": 12}),
        ((20, 0, 20, 20, 60, 4, 10, 10), {"overall": 100}),
        ((20, 0, 20, 20, 15, 4, 10, 10), {"fact_density": 50}),
        ((10, 0, 10, 10, 160, 4, 10, 10), {"fact_density": 50}),
        ((10, 0, 10, 10, 80, 4, 0, 0), {"fact_density": 100, "parse_rate": 100}),
        ((30, 20, 10, 10, 20, 4, 1, 1), {"entity_cov": 100}),
    ],
)
def test_quality(spark, row, want):
    scores = scoring.quality_scores(*[F.lit(x) for x in row])
    got = spark.range(1).select(*[v.alias(k) for k, v in scores.items()]).first()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def test_similarity(spark):
    v = scoring.vector_literal
    assert one(spark, scoring.cosine(v([1, 0]), v([1, 1]))) == pytest.approx(2**-0.5)
    assert one(spark, scoring.cosine(v([0, 0]), v([1, 1]))) is None
    t = lambda s: scoring.trigrams(F.lit(s))
    assert one(spark, t("cat")) == ["  c", " ca", "cat", "at "]
    assert one(spark, scoring.trigram_similarity(t("cat"), t("cat"))) == 1


def test_text_queries(spark):
    lex = text.lexemes(F.lit("The Service orchestrates helpers and validates payloads quickly"))
    for query, want in (("services payload", True), ("service missing", False), ("missing or payloads", True), ("service -helpers", False), ('"payloads validates"', False), ('"validates payloads"', True), ("the", False)):
        assert one(spark, text.matches(lex, query)) is want, query
    near, far = text.lexemes(F.lit("alpha beta x x x x")), text.lexemes(F.lit("alpha x x x x beta"))
    assert one(spark, text.rank_cover(near, "alpha beta")) > one(spark, text.rank_cover(far, "alpha beta")) > 0
    assert text.candidate_tokens("Who calls UserService, my_func or 'validation'?") == ["UserService", "my_func", "validation"]


def test_paths_and_weights(spark):
    edges = spark.createDataFrame([("seed", "mid", "calls"), ("mid", "leaf", "depends_on"), ("mid", "mid", "calls"), ("leaf", "mid", "calls")], "from_entity_id string, to_entity_id string, kind string")
    assert [tuple(r.path) for r in graph.paths(edges, "seed", 3).collect()] == [("seed", "mid", "leaf")]
    assert {(r.a, r.b): r.weight for r in graph.weighted(edges).collect()} == {("mid", "seed"): 3.0, ("leaf", "mid"): 5.0}


@pytest.mark.parametrize(
    "given,want",
    [('```json\n{"a": 1}\n```', {"a": 1}), ('Here it is: {"a": [1, 2,],} thanks', {"a": [1, 2]}), ('{"a": "cut of', {"a": "cut of"}), ('{"a": [1, {"b": 2', {"a": [1, {"b": 2}]}), ("no json", None), ("", None), (None, None), ('[1, 2', [1, 2])],
)
def test_clean_json(given, want):
    import json

    fixed = extraction.clean_json(given)
    assert (json.loads(fixed) if fixed else None) == want


def test_classify(spark):
    cases = {"main.go": "source", "pkg/x_test.go": "test", "vendor/a/b.go": "vendored", "README.md": "doc", "Makefile": "build", "config.yaml": "config", "logo.png": "ignored", "api.pb.go": "generated", "rows.csv": "data", "src/app.py": "source", "deploy/Dist/x.go": "vendored", "a/poetry.lock": "ignored", "x/y.tfvars": "source", "a/data.json": "data", "contest/a.go": "test", "b/Gemfile": "build", ".env": "config"}
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select("path", files.classify(F.col("path")).alias("c")).collect()
    assert {r.path: r.c for r in rows} == cases


def test_exclude(spark):
    paths = ["a/b.go", "gen/x.go", "a/gen/y.go", "keep/z.log", "w.log", "docs/api/i.md", "docs/i.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in files.exclude(rows, ["gen"], ["*.log", "!keep/z.log", "/docs/api/"]).collect()] == ["a/b.go", "a/gen/y.go", "keep/z.log", "docs/i.md"]


def test_truncate_counts_bytes(spark):
    cases = {"abcdef": "abcdef", "abcdefg": "abc...", "éééé": "é...", "aéé": "aéé", "aééé": "aé...", "": ""}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", names.truncate(F.col("t"), 6).alias("c")).collect()
    assert {r.t: r.c for r in rows} == cases


def test_calls_are_resolved_by_receiver_package_and_short_name(spark):
    entities = spark.createDataFrame([("1", "a::T", "T"), ("2", "a::T.M", "M"), ("3", "b::T", "T"), ("4", "b::T.N", "N"), ("5", "b::f", "f"), ("6", "c::f", "f"), ("7", "plain", "plain")], "id string, qualified_name string, name string")
    calls = [("T.M", "a"), ("T.M", "b"), ("T.N", ""), ("f", "b"), ("f", "z"), ("plain", "z"), ("M", "z"), ("a::T", "z"), ("none", "a"), ("T.none", "a")]
    rows = relational.resolve_calls(spark.createDataFrame(calls, "raw string, pkg string"), entities).collect()
    assert {(r.raw, r.pkg): (r.entity_id, r.certainty) for r in rows} == {
        ("T.M", "a"): ("2", "high"), ("T.M", "b"): ("2", "moderate"), ("T.N", ""): ("4", "moderate"), ("f", "b"): ("5", "high"), ("f", "z"): ("5", "low"),
        ("plain", "z"): ("7", "high"), ("M", "z"): ("2", "moderate"), ("a::T", "z"): ("1", "high"),
    }


def test_fingerprint_does_not_depend_on_order(spark):
    rows = [(i, f"t{i % 7}") for i in range(500)]
    one, two, other = (store.fingerprint(spark.createDataFrame(r, "a int, b string").repartition(n)).first().etag for r, n in ((rows, 1), (rows[::-1], 5), (rows[1:], 3)))
    assert one == two != other
