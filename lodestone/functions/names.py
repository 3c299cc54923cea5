"""Names, paths and other strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Directories that do not name a module.
PLAIN_DIRS = ("src", "lib", "internal", "pkg", "app", "source")


def normalize_name(name: Column) -> Column:
    return F.translate(name, UPPER + "_- ", UPPER.lower())


def _before_first(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def package_of(qualified: Column) -> Column:
    return F.when(F.instr(qualified, "::") > 0, _before_first(qualified, "::")).otherwise(_before_first(qualified, "."))


def owner_of(qualified: Column) -> Column:
    return F.when(F.instr(qualified, ".") > 0, F.regexp_extract(qualified, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(package_of(qualified))


def package_or_blank(qualified: Column) -> Column:
    return F.when(F.instr(qualified, "::") > 0, _before_first(qualified, "::")).otherwise(F.lit(""))


def short_name(qualified: Column) -> Column:
    """What follows the package and, in it, the last dot."""
    return F.element_at(F.split(F.element_at(F.split(qualified, "::"), -1), r"\."), -1)


def normalize_qualified(name: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.replace(name, F.lit("/"), F.lit("::")), "::"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "::")


def module_name(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: ~x.isin(*PLAIN_DIRS))
    base = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    last_two = F.slice(kept, F.greatest(F.size(kept) - 1, F.lit(1)), 2)
    return F.when(F.size(kept) > 0, F.array_join(last_two, ".")).otherwise(base)


def qualified_name(module: Column, scope: Column, name: Column) -> Column:
    return F.concat(module, F.lit("::"), F.when(F.coalesce(scope, F.lit("")) != "", F.concat(scope, F.lit("."))).otherwise(F.lit("")), name)


def name_alternatives(name: Column) -> Column:
    """Spellings under which the same thing may be stored: ``a::B::c`` as ``a::B.c``, and without a leading src:: or tests::."""
    parts = F.split(name, "::")
    dotted = F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "::"), F.lit("."), F.element_at(parts, -1))
    bare = F.regexp_replace(name, "^(src|tests)::", "")
    found = F.array(F.when(F.size(parts) > 2, dotted), F.when(bare != name, bare))
    return F.array_distinct(F.array_compact(found))


def dependency_name(name: Column) -> Column:
    return F.element_at(F.split(F.lower(name), "/"), -1)


def repo_name_of_url(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", ""), "[/:]"), -1)


def remote_owner(url: Column) -> Column:
    return F.regexp_extract(url, r"[:/]([^/:]+)/[^/]+?(?:\.git)?/?$", 1)


def name_tokens(name: Column) -> Column:
    """Words of an identifier, in lower case."""
    spaced = F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])|(?<=.)(?=[A-Z][a-z])", " ")
    return F.filter(F.transform(F.split(spaced, r"[ _\-.:/]+"), F.lower), lambda x: x != "")


def truncate(text: Column, most: int, mark: str = "...") -> Column:
    """``text`` of at most ``most`` bytes: a longer one is cut to leave place for the mark, at the last whole character."""
    head = F.substring(text.cast("binary"), 1, most - len(mark)).cast("string")
    whole = F.regexp_replace(F.make_valid_utf8(head), "\ufffd+$", "")
    return F.when(F.octet_length(text) > most, F.concat(whole, F.lit(mark))).otherwise(text)


def escape_pipes(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def ignore_line(line: Column) -> Column:
    """A line of an ignore file as a plain path; null for blanks and comments."""
    tidy = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\./", ""), "^/|/$", "")
    return F.when((tidy != "") & ~F.trim(line).startswith("#"), tidy)


def parse_date(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
