"""Source files, symbols, history and pull requests as DataFrames; classification and exclusion of paths."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import names

#: Directories, names and endings that decide a file's class.
VENDORED = ("vendor", "node_modules", "third_party", "plugins", ".next", "dist", "build", "__pycache__", ".tox", ".venv", "venv")
IGNORED_ENDINGS = ("png", "jpg", "jpeg", "gif", "svg", "ico", "woff", "woff2", "ttf", "eot", "pdf", "zip", "tar", "gz", "bz2", "exe", "dll", "so", "dylib", "lock")
GENERATED = r"\.gen\.|_gen\.|\.generated\.|_generated\.|\.pb\.|_pb2\.py$"
BUILD_FILES = (
    "go.mod", "go.sum", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.toml", "cargo.lock", "gemfile", "gemfile.lock", "requirements.txt", "pyproject.toml",
    "poetry.lock", "pom.xml", "build.gradle", "makefile", "cmakelists.txt",
)
CONFIG_FILES = (
    "dockerfile", "docker-compose.yml", "docker-compose.yaml", ".env", ".env.example", ".eslintrc", ".eslintrc.js", ".eslintrc.json", ".prettierrc", ".prettierrc.js", ".prettierrc.json", "tsconfig.json",
    ".babelrc", "webpack.config.js", "vite.config.ts", "vite.config.js", "next.config.js", "next.config.mjs", ".goreleaser.yml", ".goreleaser.yaml", "nginx.conf",
)
CONFIG_LANGUAGES = {"yml": "yaml", "yaml": "yaml", "toml": "toml", "ini": "ini", "cfg": "ini"}
DOC_ENDINGS = ("md", "rst", "txt", "adoc")
LANGUAGES = {
    "go": "go", "py": "python", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "rs": "rust", "java": "java", "rb": "ruby", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp",
    "cs": "csharp", "swift": "swift", "kt": "kotlin", "scala": "scala", "php": "php", "sh": "shell", "bash": "shell", "zsh": "shell", "lua": "lua", "r": "r", "sql": "sql", "proto": "protobuf",
    "tf": "terraform", "tfvars": "terraform", "hcl": "hcl", "j2": "jinja2", "jinja": "jinja2", "tmpl": "gotemplate", "tpl": "gotemplate", "ex": "elixir", "exs": "elixir", "zig": "zig", "dart": "dart", "nix": "nix",
}
DATA_ENDINGS = ("json", "csv", "xml")
MANIFESTS = (
    "go.mod", "go.sum", "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "pyproject.toml", "cargo.toml", "cargo.lock", "gemfile", "gemfile.lock", "pom.xml",
    "build.gradle", "build.gradle.kts", "composer.json", "pubspec.yaml", "mix.exs", "package.swift", "dockerfile",
)
ANALYZED = ("source", "config", "doc", "build")
TRIVIAL_TITLE = r"(?i)^(chore|ci|docs|bump|update dependencies|dependabot)"
#: Folders of tools, which read_files leaves out beside the vendored ones.
SKIPPED_DIRS = (".git", ".idea", ".vscode", *VENDORED)


def _base(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def _folder(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_test(path: Column) -> Column:
    """By the name, or by a folder whose name has test or spec in it."""
    return _base(path).rlike(r"_test\.(go|py)$|^test_|\.test\.|\.spec\.") | _folder(path).rlike("test|spec")


def _by_ending(path: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), ending(path))


def classify(path: Column) -> Column:
    """vendored, ignored, generated, build, config, doc, test, source, data; the first that fits."""
    vendored = F.arrays_overlap(F.split(_folder(path), "/"), F.array(*[F.lit(d) for d in VENDORED]))
    return (
        F.when(vendored, "vendored")
        .when(ending(path).isin(*IGNORED_ENDINGS), "ignored")
        .when(_base(path).rlike(GENERATED), "generated")
        .when(_base(path).isin(*BUILD_FILES), "build")
        .when(_base(path).isin(*CONFIG_FILES) | ending(path).isin(*CONFIG_LANGUAGES), "config")
        .when(ending(path).isin(*DOC_ENDINGS), "doc")
        .when(is_test(path), "test")
        .when(_by_ending(path, LANGUAGES).isNotNull(), "source")
        .when(ending(path).isin(*DATA_ENDINGS), "data")
        .otherwise("ignored")
    )


def language(path: Column) -> Column:
    """Of sources and tests by the ending; markup of configurations and documents; null for others."""
    kind = classify(path)
    config = F.when(~_base(path).isin(*CONFIG_FILES), _by_ending(path, CONFIG_LANGUAGES))
    return F.when(kind == "config", config).when(kind == "doc", "markdown").when(kind.isin("test", "source"), _by_ending(path, LANGUAGES))


def is_manifest(path: Column) -> Column:
    return _base(path).isin(*MANIFESTS) | (ending(path) == "csproj")


def analyzable(files: DataFrame) -> DataFrame:
    return files.where(F.col("class").isin(*ANALYZED))


def glob_regex(pattern: str) -> str:
    """An ignore-file pattern as a regular expression over relative paths: what it names, and all below it."""
    anchored = "/" in pattern.rstrip("/")
    body = re.escape(pattern.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return ("^" if anchored else "(?:^|/)") + body + "(?:/|$)"


def exclude(files: DataFrame, directories: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """Without files below the directories, then without those that a pattern names (``!`` takes a pattern's files back)."""
    gone = F.lit(False)
    for d in dict.fromkeys(x.strip("/") for x in directories if x.strip("/")):
        gone = gone | (F.col("path") == d) | F.col("path").startswith(d + "/")
    for p in dict.fromkeys(x.strip() for x in patterns):
        if p and not p.startswith("#"):
            gone = F.when(F.col("path").rlike(glob_regex(p.lstrip("!"))), F.lit(not p.startswith("!"))).otherwise(gone)
    return files.where(~gone)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content_hash, content) of every file below ``root``, without version control and vendored folders."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_replace(F.col("path"), "^(?:file:)?/*", "/")
    relative = F.expr(f"substring(p, {len(root.rstrip('/')) + 2})") if root.startswith("/") else F.col("p")
    found = raw.withColumn("p", inside).select(relative.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), "content")
    return found.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in SKIPPED_DIRS])))


def tracked_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files that version control tracks: a listing made on the driver, as the tool gives it."""
    out = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, text=True, check=True).stdout
    return spark.createDataFrame([(p,) for p in out.split("\0") if p], "path string")


def head_content(files: DataFrame, most: int = 500_000) -> DataFrame:
    """Contents up to ``most`` bytes, of paths that stay inside their root."""
    safe = ~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), "..")
    return files.where(safe).withColumn("content", F.substring("content", 1, most))


def detect_repo(root: str) -> dict[str, str]:
    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True).stdout.strip()
    return {"remote_url": git("remote", "get-url", "origin"), "default_branch": git("rev-parse", "--abbrev-ref", "HEAD"), "last_commit_sha": git("rev-parse", "HEAD")}


def remote_parts(url: Column) -> Column:
    """struct(owner, repo) of an https or ssh address; null if it is neither."""
    pattern = r"^(?:https?://[^/]+/|(?:ssh://)?[^@]+@[^:/]+[:/])([^/]+)/([^/]+?)(?:\.git)?/?$"
    return F.when(url.rlike(pattern), F.struct(F.regexp_extract(url, pattern, 1).alias("owner"), F.regexp_extract(url, pattern, 2).alias("repo")))


LOG_FIELDS = "COMMIT_BOUNDARY%n%H%n%an%n%aI%n%B%nFILES_BOUNDARY"


def parse_log(text: DataFrame) -> DataFrame:
    """(value): one block a commit -> sha, author, date, message, files_changed."""
    lines = F.split(F.trim(F.regexp_replace("value", "^COMMIT_BOUNDARY\n", "")), "\n")
    head, files = F.split("value", "\nFILES_BOUNDARY").getItem(0), F.split("value", "\nFILES_BOUNDARY").getItem(1)
    message = F.array_join(F.slice(F.split(F.regexp_replace(head, "^\\s*(?:COMMIT_BOUNDARY\n)?", ""), "\n"), 4, F.size(lines)), "\n")
    return text.where(F.size(lines) >= 4).select(
        lines[0].alias("sha"), lines[1].alias("author"), names.parse_date(lines[2]).alias("date"), F.trim(message).alias("message"),
        F.filter(F.transform(F.split(F.coalesce(files, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("files_changed"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.option("lineSep", "COMMIT_BOUNDARY\n").text(path))


#: Kinds of symbols that are kept.
SYMBOL_KINDS = ("function", "func", "method", "class", "struct", "interface", "type", "enum", "trait", "const", "constant", "module")


def parse_symbols(lines: DataFrame) -> DataFrame:
    """(value): a JSON object a line -> path, name, kind, line, scope, signature, typeref, qualified_name and end_line."""
    from pyspark.sql import Window

    row = F.from_json("value", "name string, path string, kind string, line int, scope string, scopeKind string, signature string, typeref string")
    found = lines.select(row.alias("r")).select("r.*").where(F.col("kind").isin(*SYMBOL_KINDS) & F.col("name").isNotNull())
    found = found.withColumn("path", F.regexp_replace("path", r"^\./", "")).where(~(is_test(F.col("path")) & F.col("kind").isin("const", "constant")))
    following = F.lead("line").over(Window.partitionBy("path").orderBy("line", "name")) - 1
    qualified = names.qualified_name(names.module_name(F.col("path")), F.col("scope"), F.col("name"))
    return found.withColumn("end_line", following).withColumn("qualified_name", qualified)


def go_imports(files: DataFrame) -> DataFrame:
    """(path, content) of Go files -> path, import."""
    text = F.col("content").cast("string")
    blocks = F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)\bimport\s*\((.*?)\)"), F.lit(1)), "\n")
    inside = F.regexp_extract_all(blocks, F.lit(r'(?m)^\s*(?:[\w.]+\s+)?"([^"]+)"'), F.lit(1))
    single = F.regexp_extract_all(text, F.lit(r'(?m)^import\s+(?:[\w.]+\s+)?"([^"]+)"'), F.lit(1))
    own = files.where(F.col("path").endswith(".go"))
    return own.select("path", F.explode(F.array_distinct(F.concat(single, inside))).alias("import"))


def go_calls(files: DataFrame) -> DataFrame:
    """(path, content) of Go files -> path, caller, callee: calls by the function whose body holds them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start = re.compile(r"^func\s+(?:\(\s*\w*\s*\*?(\w+)[^)]*\)\s*)?(\w+)")
        call = re.compile(r"(?<![\w.])((?:\w+\.)*\w+)\(")
        words = {"if", "for", "switch", "func", "return", "make", "len", "append", "new", "panic", "cap", "copy", "delete", "range", "go", "defer", "select"}
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                caller = None
                for line in bytes(content).decode("utf-8", "replace").split("\n"):
                    if m := start.match(line):
                        caller = f"{m[1]}.{m[2]}" if m[1] else m[2]
                        continue
                    if line.startswith("}"):
                        caller = None
                    elif caller:
                        out += [(path, caller, c) for c in call.findall(line.split("//")[0]) if c not in words]
            yield pd.DataFrame(list(dict.fromkeys(out)), columns=["path", "caller", "callee"])

    own = files.where(F.col("path").endswith(".go")).select("path", "content")
    return own.mapInPandas(run, "path string, caller string, callee string")


def go_embeddings(files: DataFrame) -> DataFrame:
    """(path, content) of Go files -> path, type, embedded: types that a struct or interface holds without a field name."""
    text = F.col("content").cast("string")
    pattern = r"(?ms)^type\s+(\w+)\s+(?:struct|interface)\s*\{(.*?)^\}"
    types, bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    each = files.where(F.col("path").endswith(".go")).select("path", F.explode(F.arrays_zip(types.alias("type"), bodies.alias("body"))).alias("t"))
    return each.select("path", F.col("t.type").alias("type"), F.explode(F.regexp_extract_all(F.col("t.body"), F.lit(r"(?m)^\s+\*?((?:\w+\.)?[A-Z]\w*)\s*$"), F.lit(1))).alias("embedded"))


PULL_REQUEST = "number int, title string, url string, author string, merged_at string, body string, labels array<string>, review_comments array<struct<author:string,body:string,state:string>>, linked_issues array<struct<number:int,title:string,body:string,labels:array<string>>>"


def read_pull_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PULL_REQUEST).json(path)


def worthwhile_pull_requests(prs: DataFrame) -> DataFrame:
    """Without trivial ones: short bodies, housekeeping titles, and short ones that nobody discussed."""
    length = F.length(F.coalesce("body", F.lit("")))
    quiet = (F.coalesce(F.size("review_comments"), F.lit(0)) <= 0) & (F.coalesce(F.size("linked_issues"), F.lit(0)) <= 0)
    return prs.where(~((length < 50) | F.coalesce(F.col("title").rlike(TRIVIAL_TITLE), F.lit(False)) | (quiet & (length < 150))))


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """Chat sessions, newest first, with the number of their messages."""
    schema = "id string, title string, created_at timestamp, updated_at timestamp, messages array<struct<role:string,content:string>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.withColumn("n_messages", F.size("messages")).orderBy(F.desc("updated_at"), "id")


def chat_title(first: Column, most: int = 50) -> Column:
    return names.truncate(first, most)


def embed_column(rows: DataFrame, column: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 128) -> DataFrame:
    """``rows`` (id, text) -> id, embedding through a service that takes ``batch`` texts at a time and keeps their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": embed(part[column].fillna("").tolist())})

    return rows.select("id", column).mapInPandas(run, "id string, embedding array<float>")
