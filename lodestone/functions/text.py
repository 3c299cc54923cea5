"""Full-text search: tokens, stems, query syntax and ranks, as Column expressions wherever the text is data.

A text's lexemes can be stored beside it (``plans.search.index_texts``); without that they are made of the texts that may match,
which a search for the query's stems in the raw text tells beforehand.  A query is parsed on the driver into clauses of required, excluded
and alternative terms (quoted terms are phrases), which become array predicates.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been before being both but by can did do does doing down each few for from further "
    "had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or "
    "other our out over own same she so some such than that the their them then there these they this those through to too under until up very "
    "was we were what when where which while who whom why will with you your".split()
)
WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Words in lower case, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD), lambda x: x != "")


def stem(word: Column) -> Column:
    """A light English stem: plural, -ing and -ed endings; the same rule for texts and queries."""
    w = F.when(word.rlike("(ss|us|is)$"), word).when(word.rlike("ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
    w = w.when(word.rlike("(sh|ch|x|z|ss)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^s]s$") & (F.length(word) > 3), F.regexp_replace(word, "s$", ""))
    w = w.when(word.rlike("[aeiouy].*ing$") & (F.length(word) > 5), F.regexp_replace(word, "ing$", "")).when(word.rlike("[aeiouy].*ed$") & (F.length(word) > 4), F.regexp_replace(word, "ed$", ""))
    return w.otherwise(word)


def lexemes(text: Column) -> Column:
    """Stems in order, without stop words; the array's places are the positions."""
    return F.transform(F.filter(tokens(text), lambda x: ~x.isin(*sorted(STOP_WORDS))), stem)


@dataclass(frozen=True)
class Clause:
    """Alternatives, each a phrase of one word or more; ``excluded`` if none may occur."""

    phrases: tuple[tuple[str, ...], ...]
    excluded: bool = False


def parse_query(query: str) -> list[Clause]:
    """Words are all required, ``or`` joins neighbours, ``-`` excludes, quotes make phrases; stop words are dropped."""
    clauses: list[Clause] = []
    joining = False
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and clauses:
            joining = True
            continue
        words = tuple(w for w in re.findall(r"[^\W_]+", (quoted or word).lower()) if w not in STOP_WORDS)
        if words:
            if joining and not minus and not clauses[-1].excluded:
                clauses[-1] = Clause((*clauses[-1].phrases, words))
            else:
                clauses.append(Clause((words,), bool(minus)))
        joining = False
    return clauses


def _stems(words: tuple[str, ...]) -> list[Column]:
    return [stem(F.lit(w)) for w in words]


def _has_phrase(lex: Column, words: tuple[str, ...]) -> Column:
    if len(words) == 1:
        return F.array_contains(lex, _stems(words)[0])
    wanted = _stems(words)
    last = F.size(lex) - len(words)

    def here(i: Column) -> Column:
        same = F.lit(True)
        for k, w in enumerate(wanted):
            same = same & (F.get(lex, i + k) == w)
        return same

    return F.when(last >= 0, F.exists(F.sequence(F.lit(0), last), here)).otherwise(F.lit(False))


def matches(lex: Column, query: str) -> Column:
    out = F.lit(True)
    clauses = parse_query(query)
    for c in clauses:
        one = F.lit(False)
        for p in c.phrases:
            one = one | _has_phrase(lex, p)
        out = out & (~one if c.excluded else one)
    return out if clauses else F.lit(False)


def may_match(raw: Column, query: str) -> Column:
    """False only of texts that cannot match: a word's stem, but for a final y, is part of every word with that stem."""
    low, out = F.lower(F.coalesce(raw, F.lit(""))), F.lit(True)
    root = lambda w: F.regexp_replace(stem(F.lit(w)), "y$", "")
    for c in parse_query(query):
        if not c.excluded:
            one = F.lit(False)
            for p in c.phrases:
                whole = F.lit(True)
                for w in p:
                    whole = whole & F.contains(low, root(w))
                one = one | whole
            out = out & one
    return out


def _terms(query: str) -> Column:
    words = dict.fromkeys(w for c in parse_query(query) if not c.excluded for p in c.phrases for w in p)
    return F.array_distinct(F.array(*[stem(F.lit(w)) for w in words])) if words else F.array().cast("array<string>")


def rank_frequency(lex: Column, query: str) -> Column:
    """Mean over the query's terms of 1 - 1 / (1 + occurrences)."""
    wanted = _terms(query)
    each = F.transform(wanted, lambda t: 1 - 1 / (1 + F.size(F.filter(lex, lambda x: x == t))))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(wanted), F.lit(1))


def rank_cover(lex: Column, query: str) -> Column:
    """Cover density: the number of the query's terms over the length of each shortest stretch that holds them all."""
    wanted = _terms(query)
    hits = F.filter(F.transform(lex, lambda x, i: F.struct(i.alias("at"), F.array_position(wanted, x).cast("int").alias("term"))), lambda h: h["term"] > 0)
    return _cover(hits, wanted)


def _cover(hits: Column, wanted: Column) -> Column:
    """Cover density from the places of terms (at, and the term's number from 1), in order of place."""
    n = F.size(wanted)
    start = F.struct(F.transform(wanted, lambda _: F.lit(-1)).alias("last"), F.lit(0.0).alias("sum"), F.lit(-1).alias("from"))

    def step(s: Column, h: Column) -> Column:
        last = F.transform(s["last"], lambda p, i: F.when(i + 1 == h["term"], h["at"]).otherwise(p))
        first = F.array_min(last)
        new = (first >= 0) & (first > s["from"])
        gain = F.when(new, n / (h["at"] - first + 1)).otherwise(F.lit(0.0))
        return F.struct(last.alias("last"), (s["sum"] + gain).alias("sum"), F.when(new, first).otherwise(s["from"]).alias("from"))

    return F.aggregate(hits, start, step, lambda s: s["sum"])


# The same from stored places of terms instead of lexemes: word -> array of places, null where a text lacks it.


def has_phrase_at(places: list[Column]) -> Column:
    """Whether the terms of a phrase stand one after the other."""
    if len(places) == 1:
        return places[0].isNotNull()
    starts = places[0]
    for k, p in enumerate(places[1:], 1):
        starts = F.array_intersect(starts, F.transform(p, _less(k)))
    return F.coalesce(F.size(starts) > 0, F.lit(False))


def _less(k: int) -> Callable[[Column], Column]:
    return lambda x: x - k


def _by_stem(places: dict[str, Column]) -> tuple[Column, Column]:
    """The distinct stems of the words, and an array of the places of each."""
    stems = F.array(*[stem(F.lit(w)) for w in places])
    each = F.array(*[F.coalesce(p, F.array().cast("array<int>")) for p in places.values()])
    first = F.filter(F.transform(stems, lambda s, i: F.struct((F.array_position(stems, s) == i + 1).alias("own"), F.get(each, i).alias("at"))), lambda x: x["own"])
    return F.array_distinct(stems), F.transform(first, lambda x: x["at"])


def rank_frequency_at(places: dict[str, Column]) -> Column:
    if not places:
        return F.lit(0.0)
    stems, at = _by_stem(places)
    return F.aggregate(F.transform(at, lambda p: 1 - 1 / (1 + F.size(p))), F.lit(0.0), lambda a, x: a + x) / F.size(stems)


def rank_cover_at(places: dict[str, Column]) -> Column:
    if not places:
        return F.lit(0.0)
    stems, at = _by_stem(places)
    hits = F.flatten(F.transform(at, lambda p, i: F.transform(p, lambda x: F.struct(x.alias("at"), (i + 1).alias("term")))))
    return _cover(F.array_sort(hits), stems)


def candidate_tokens(question: str) -> list[str]:
    """Words of a question that look like identifiers: camel case, underscores, or over six bytes; in order, repeats included."""
    words = (w.strip("'\"()") for w in re.split(r"[\s,?!.;:]+", question))
    return [w for w in words if w and (re.search("[a-z][A-Z]", w) or "_" in w or len(w.encode()) > 6)]
