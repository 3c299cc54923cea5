"""Dependency manifests: thirteen formats to rows of path, name, version, dev and source.

Formats with a regular shape are Column expressions; TOML is parsed in Arrow batches with the standard library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "path string, name string, version string, dev boolean, source string"


def _text() -> Column:
    return F.col("content").cast("string")


def _base() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def _rows(files: DataFrame, found: Column, source: str) -> DataFrame:
    """``found``: array<struct<name, version, dev>>."""
    each = files.select("path", F.explode(found).alias("d"))
    tidy = each.select("path", F.col("d.name").alias("name"), F.coalesce("d.version", F.lit("")).alias("version"), F.col("d.dev").alias("dev"), F.lit(source).alias("source"))
    return tidy.where(F.coalesce(F.col("name"), F.lit("")) != "")


def _pairs(text: Column, pattern: str, dev: Column | None = None) -> Column:
    """Groups 1 and 2 of every match as name and version."""
    a, b = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(a, b, lambda n, v: F.struct(n.alias("name"), v.alias("version"), (F.lit(False) if dev is None else dev).alias("dev")))


def go_mod(files: DataFrame) -> DataFrame:
    blocks = F.array_join(F.concat(F.regexp_extract_all(_text(), F.lit(r"(?ms)^require\s*\((.*?)^\s*\)"), F.lit(1)), F.regexp_extract_all(_text(), F.lit(r"(?m)^require\s+([^(\s].*)$"), F.lit(1))), "\n")
    pattern = r"(?m)^\s*([^\s/][^\s]*)\s+(v[^\s]+)(.*)$"
    parts = [F.regexp_extract_all(blocks, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    found = F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "nvr", strict=True)]), lambda x: F.struct(x["n"].alias("name"), x["v"].alias("version"), F.contains(x["r"], F.lit("// indirect")).alias("dev")))
    return _rows(files.where(_base() == "go.mod"), found, "go.mod")


def _json_maps(files: DataFrame, base: str, normal: str, dev: str, skip: tuple[str, ...] = ()) -> DataFrame:
    parsed = F.from_json(_text(), f"`{normal}` map<string,string>, `{dev}` map<string,string>")
    each = lambda key, is_dev: F.transform(F.map_entries(F.coalesce(parsed[key], F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(is_dev).alias("dev")))
    found = F.filter(F.concat(each(normal, False), each(dev, True)), lambda d: ~d["name"].isin(*skip) if skip else F.lit(True))
    return _rows(files.where(_base() == base), found, base)


def package_json(files: DataFrame) -> DataFrame:
    return _json_maps(files, "package.json", "dependencies", "devDependencies")


def composer_json(files: DataFrame) -> DataFrame:
    return _json_maps(files, "composer.json", "require", "require-dev", ("php",))


def requirements_txt(files: DataFrame) -> DataFrame:
    pattern = r"(?m)^(?!\s*[#-])\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:[=<>!~]=?\s*([^\s,;#]+))?"
    return _rows(files.where(_base() == "requirements.txt"), _pairs(_text(), pattern), "requirements.txt")


#: A Ruby string without interpolation: quoted, or %q with brackets.
_RUBY_STRING = r"""'[^']*'|"[^"]*"|%[qQ](?:\([^)]*\)|\{[^}]*\}|\[[^\]]*\])"""


def gemfile(files: DataFrame) -> DataFrame:
    """Calls of ``gem``, with or without parentheses, over one line or several: the strings before the options are name and requirements."""
    bare = F.regexp_replace(_text(), r"(?m)(^|\s)#.*$", "")
    lines = F.split(F.regexp_replace(bare, r",\s*\n", ", "), r"[\n;]")
    given = F.transform(F.filter(lines, lambda x: F.trim(x).rlike(r"^gem\b")), lambda x: F.regexp_replace(F.trim(x), r"^gem\s*\(?\s*", ""))
    strings = F.transform(given, lambda x: F.regexp_extract_all(F.regexp_extract(x, rf"^(?:(?:{_RUBY_STRING})\s*(?:,\s*|$|\)|(?=\s)))+", 0), F.lit(_RUBY_STRING), F.lit(0)))
    plain = F.transform(strings, lambda own: F.transform(own, lambda x: F.regexp_replace(x, r"""^(%[qQ])?.|.$""", "")))
    found = F.transform(plain, lambda x: F.struct(F.get(x, F.lit(0)).alias("name"), F.array_join(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), ", ").alias("version"), F.lit(False).alias("dev")))
    return _rows(files.where(_base() == "Gemfile"), found, "Gemfile")


def pom_xml(files: DataFrame) -> DataFrame:
    block = F.regexp_extract_all(_text(), F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    tag = lambda x, t: F.trim(F.regexp_extract(x, f"<{t}>([^<]*)</{t}>", 1))
    found = F.transform(block, lambda x: F.struct(F.concat_ws(":", tag(x, "groupId"), tag(x, "artifactId")).alias("name"), tag(x, "version").alias("version"), (tag(x, "scope") == "test").alias("dev")))
    return _rows(files.where(_base() == "pom.xml"), found, "pom.xml")


def build_gradle(files: DataFrame) -> DataFrame:
    pattern = r"""(?m)^\s*(implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|testCompileOnly|compile|testCompile)\s*\(?\s*['"]([^'"]+)['"]"""
    kinds, specs = F.regexp_extract_all(_text(), F.lit(pattern), F.lit(1)), F.regexp_extract_all(_text(), F.lit(pattern), F.lit(2))
    parts = lambda s: F.split(s, ":")
    found = F.zip_with(kinds, specs, lambda k, s: F.struct(F.array_join(F.slice(parts(s), 1, 2), ":").alias("name"), F.coalesce(F.get(parts(s), F.lit(2)), F.lit("")).alias("version"), F.lower(k).startswith("test").alias("dev")))
    return _rows(files.where(_base().isin("build.gradle", "build.gradle.kts")), found, "build.gradle")


def pubspec_yaml(files: DataFrame) -> DataFrame:
    # possessive, so that a block's lines are matched in a loop: otherwise each line nests a call, and long blocks overflow the stack
    one = lambda key, dev: _pairs(F.regexp_extract(_text(), rf"(?m)^{key}:\s*\n((?:[ \t]+.*\n?|\s*\n)*+)", 1), r"(?m)^ {2}(\w[\w-]*):[ \t]*(.*?)[ \t]*$", F.lit(dev))
    found = F.filter(F.concat(one("dependencies", False), one("dev_dependencies", True)), lambda d: ~d["name"].isin("flutter", "flutter_test"))
    return _rows(files.where(_base() == "pubspec.yaml"), found, "pubspec.yaml")


def mix_exs(files: DataFrame) -> DataFrame:
    """Tuples of an atom and a requirement, or an atom and where it comes from (no version), over one line or several."""
    bare = F.regexp_replace(_text(), r"(?m)(^|\s)#.*$", "")
    tuple_ = r"(?s)\{\s*:([a-z_][A-Za-z0-9_]*)\s*,([^{}]*)\}"
    names_, rest = F.regexp_extract_all(bare, F.lit(tuple_), F.lit(1)), F.regexp_extract_all(bare, F.lit(tuple_), F.lit(2))
    both = F.filter(F.arrays_zip(names_.alias("n"), rest.alias("r")), lambda x: x["r"].rlike(r"""(?s)^\s*("|(\[\s*)?(git|github|path|in_umbrella|hex):)"""))
    found = F.transform(both, lambda x: F.struct(x["n"].alias("name"), F.regexp_extract(x["r"], r"""^\s*"([^"]*)\"""", 1).alias("version"), F.lit(False).alias("dev")))
    return _rows(files.where(_base() == "mix.exs"), found, "mix.exs")


def package_swift(files: DataFrame) -> DataFrame:
    pattern = r"""\.package\(\s*(?:name:\s*"[^"]*"\s*,\s*)?url:\s*"([^"]+)"(?:\s*,\s*[^")]*"([^"]+)")?"""
    raw = _pairs(_text(), pattern)
    found = F.transform(raw, lambda d: F.struct(F.regexp_replace(F.element_at(F.split(d["name"], "/"), -1), r"\.git$", "").alias("name"), d["version"].alias("version"), d["dev"].alias("dev")))
    return _rows(files.where(_base() == "Package.swift"), found, "Package.swift")


def csproj(files: DataFrame) -> DataFrame:
    return _rows(files.where(F.col("path").endswith(".csproj")), _pairs(_text(), r"""<PackageReference\s+Include="([^"]+)"(?:[^>]*?\sVersion="([^"]+)")?"""), "csproj")


def _toml_rows(path: str, content: bytes) -> list[tuple[str, str, str, bool, str]]:
    import re
    import tomllib

    try:
        data = tomllib.loads(bytes(content).decode("utf-8", "replace"))
    except tomllib.TOMLDecodeError:
        return []
    version = lambda v: v if isinstance(v, str) else str(v.get("version", "")) if isinstance(v, dict) else ""
    base = path.rsplit("/", 1)[-1]
    if base == "Cargo.toml":
        return [(path, n, version(v), dev, base) for key, dev in (("dependencies", False), ("dev-dependencies", True)) for n, v in data.get(key, {}).items()]
    out = []
    for spec in data.get("project", {}).get("dependencies", []):
        if m := re.match(r"\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:[=<>!~]=?\s*([^\s,;]+))?", spec):
            out.append((path, m[1], m[2] or "", False, base))
    poetry = data.get("tool", {}).get("poetry", {})
    groups = [(poetry.get("dependencies", {}), False), (poetry.get("dev-dependencies", {}), True)]
    groups += [(g.get("dependencies", {}), True) for g in poetry.get("group", {}).values()]
    return out + [(path, n, version(v), dev, base) for group, dev in groups for n, v in group.items() if n != "python"]


def toml(files: DataFrame) -> DataFrame:
    """pyproject.toml and Cargo.toml."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"], strict=True) for r in _toml_rows(p, c)]
            yield pd.DataFrame(rows, columns=["path", "name", "version", "dev", "source"])

    own = files.where(_base().isin("pyproject.toml", "Cargo.toml")).select("path", F.col("content").cast("binary").alias("content"))
    return own.mapInPandas(run, ROW)


READERS = (go_mod, package_json, requirements_txt, toml, gemfile, pom_xml, build_gradle, composer_json, pubspec_yaml, mix_exs, package_swift, csproj)


def dependencies(files: DataFrame) -> DataFrame:
    """(path, content) -> the dependencies of every manifest among them."""
    out = READERS[0](files)
    for read in READERS[1:]:
        out = out.unionByName(read(files))
    return out
