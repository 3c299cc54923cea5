"""Merkle manifest, packing and fill-in-the-middle: brute force, round trips and odd tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import infill, merkle, packing, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", None, 0), (2, "A b", None, "", 3), (2, "A b", None, "", 3), (2, "c", None, "", 1), (-5, "é<P>\n", "fr", "é", 4), (7, " \t\n", None, "z", 3)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---- Merkle manifest


def up(level):
    return [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append(up(levels[-1]))
    return levels


def siblings(levels, pos):
    out = []
    for level in levels[:-1]:
        run = level[pos // 16 * 16 :][:16]
        out.append(("".join(run[: pos % 16]), "".join(run[pos % 16 + 1 :])))
        pos //= 16
    return out


def leaf_of(r, text):
    parts = [r[0], r[3], r[2], r[4], text]
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in parts))


def plain_manifest(rows):
    by_source = defaultdict(list)
    for r in rows:
        lower = r[1] if r[1] is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), leaf_of(r, lower if hit else r[1]), r[0]))
    names = sorted(by_source, key=lambda s: b"" if s is None else b"=" + s.encode())
    trees = {s: tree([x[2] for x in sorted(by_source[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for i, s in enumerate(names):
        for pos, (_, _, leaf, tampered, doc_id) in enumerate(sorted(by_source[s])):
            steps = siblings(trees[s], pos) + siblings(top, i)
            folded = tampered
            for a, b in steps:
                folded = sha(a + folded + b)
            out.append((doc_id, leaf, trees[s][-1][0], root, sha("".join(a + b for a, b in steps)), folded, folded == root))
    return out


def manifest_of(spark, frame, levels=merkle.LEVELS):
    lowered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [tuple(r) for r in merkle.manifest(frame, lowered, levels=levels).collect()]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_is_that_of_plain_trees(spark, levels):
    """Sources of 1, 16, 17, 257 and 600 rows, so that traversals of every number of rounds occur, with odd rows among them."""
    sizes = {"a": 1, "b": 16, "c": 17, "Zz": 257, None: 600, **{f"s{i:02d}": 1 + i % 3 for i in range(20)}}
    rows = [(1000 * k + i, f"Text {i % 40} ABC", "en" if i % 3 else None, s, i) for k, (s, n) in enumerate(sizes.items()) for i in range(n)] + ODD
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = manifest_of(spark, frame, levels)
    assert sorted(got, key=str) == sorted(plain_manifest(rows), key=str)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_odd_tables(spark):
    frame = spark.createDataFrame(ODD, SCHEMA)
    clashing = frame.withColumn("leaf", F.lit(1)).withColumn("root", F.lit(2)).withColumn("digest", F.lit(3)).withColumn("key", F.lit(4)).withColumn("pos", F.lit(5))
    want = sorted(plain_manifest(ODD), key=str)
    assert sorted(manifest_of(spark, frame), key=str) == want == sorted(manifest_of(spark, clashing), key=str)
    assert manifest_of(spark, frame.where("false")) == []
    one = [(4, "x", None, "s", 1)]
    assert manifest_of(spark, spark.createDataFrame(one, SCHEMA)) == plain_manifest(one)
    same = [(3, "x", None, "s", 1)] * 40
    assert sorted(manifest_of(spark, spark.createDataFrame(same, SCHEMA))) == sorted(plain_manifest(same))


def test_traversal_appends_the_siblings_of_every_leaf():
    for n in (1, 2, 16, 17, 255, 256, 257, 300):
        nodes = [sha(str(i)) for i in range(n)]
        levels = tree(nodes)
        steps = [[] for _ in nodes]
        assert merkle.traverse(nodes, len(levels) - 1, steps) == levels[-1][0]
        assert steps == [siblings(levels, i) for i in range(n)]
        assert all(merkle.fold(nodes[i], steps[i]) == levels[-1][0] for i in (0, n - 1))
    assert merkle.traverse(["x"], 2) == sha(sha("x"))  # a short last block climbs as far as the others


# ---- packing


def library():
    return Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))


def plain_ids(texts):
    return [x.ids for x in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(encoder, texts):
    flat, sizes = encoder.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


ATOMS = [*"aZé ßÿÀ1٣²ǅ中İΣς́_'.,!?%-<|>\n\t\r\x0b\x0c\x1c\x85\xa0 ", " a", "'s ", "don't", "<|endoftext|>", "<|startoftext|>", "🙂", "é", "Å"]


@given(st.lists(st.lists(st.sampled_from(ATOMS), max_size=40).map("".join), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_any_text_gives_the_word_tokenizers_own_ids(texts):
    global _fuzzed
    _fuzzed = _fuzzed or (packing.WordEncoder(tokens.tokenizer_path("word_bpe_49k.json"), 4000), library())
    assert encoded(_fuzzed[0], texts) == [x.ids for x in _fuzzed[1].encode_batch(texts, add_special_tokens=False)]


_fuzzed = None


def test_words_give_the_tokenizers_own_ids(spark):
    texts = ["", " ", None, "word " * 30_000, "é" * 9_000, "It's <|endoftext|> x<|endoftext|>y"]
    texts += [f"{chr(c)}a. B{chr(c)}!" for c in range(33, 0x250)] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_ids(texts)
    for cache in (24 << 20, 2000, 0):
        encoder = packing.WordEncoder(tokens.tokenizer_path("word_bpe_49k.json"), cache)
        assert encoded(encoder, texts) == want
        assert encoded(encoder, texts[::-1]) == want[::-1]


def naive_best_fit(sizes, limits):
    """Every sequence ever opened is looked at for every piece."""
    caps, rest, out = (limits.tokens, limits.pieces, limits.attention), [], []
    for n in sizes:
        need, best = (n, 1, n * n), None
        for i, r in enumerate(rest):
            left = [a - b for a, b in zip(r, need)]
            if min(left) >= 0:
                if limits.rule == "norm":
                    score = sum(w * (x / c) ** 2 for w, x, c in zip(limits.weights, left, caps))
                else:
                    score = sum(w * x / c * y / c for w, x, y, c in zip(limits.weights, left, need, caps))
                if best is None or score < best[0] - 1e-12:
                    best = (score, i)
        if best is None:
            rest.append(list(caps))
            best = (0, len(rest) - 1)
        rest[best[1]] = [a - b for a, b in zip(rest[best[1]], need)]
        out.append(best[1])
    return out, rest


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("pieces", "attention"), [(2048, 2048**2), (3, 2048**2), (2048, 2048**2 // 2), (4, 300_000)])
def test_best_fit_keeps_every_constraint_and_fills_as_well_as_the_naive_version(rule, pieces, attention):
    rng = np.random.default_rng(pieces)
    limits = packing.Capacity(2048, pieces, attention, (1.0, 0.5, 0.3), rule)
    sizes = sorted(np.minimum(rng.integers(1, 1200, 400), int(attention**0.5)).tolist(), reverse=True)
    bins = packing.best_fit(sizes, limits)
    for b in set(bins.tolist()):
        own = [s for s, x in zip(sizes, bins) if x == b]
        assert sum(own) <= 2048 and len(own) <= pieces and sum(s * s for s in own) <= attention
    naive, rest = naive_best_fit(sizes, limits)
    assert abs(len(set(bins.tolist())) - len(rest)) <= 1 + len(rest) // 100  # ties may differ
    assert set(bins.tolist()) == set(range(len(set(bins.tolist()))))
    if rule == "norm":
        assert len(rest) == len(set(bins.tolist()))


def check_packing(out, rows, capacity=2048, pieces=2048, attention=2048**2, tokens_=2048):
    """Every row's ids in its pieces; sequences without gaps, within every constraint."""
    want = sorted((-(10**9) if r[0] is None else r[0], [*ids, 0]) for r, ids in zip(rows, plain_ids([r[1] for r in rows])))
    expected = sorted((d, k, k * capacity, len(ids[k * capacity :][:capacity]), zlib.crc32(np.array(ids[k * capacity :][:capacity], dtype="<u4").tobytes())) for d, ids in want for k in range(-(-len(ids) // capacity)))
    assert sorted((-(10**9) if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= tokens_ and len(own) <= pieces and sum(n * n for _, n in own) <= attention
    return len(by)


def test_sequences_hold_all_documents(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + [(r[0], r[1]) for r in ODD]
    rows += [(10**6, "many words " * 5000), (10**6 + 1, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("block", F.lit("x")).withColumn("length", F.lit(2))
    packing.pack_sequences(frame.repartition(5), f"{tmp_path}/s")
    out = packing.read_pieces(spark, f"{tmp_path}/s").collect()
    least = -(-sum(r.length for r in out) // 2048)
    assert check_packing(out, rows) <= least + 1 + least // 200
    packing.pack_sequences(frame, f"{tmp_path}/b", pieces_a_block=100)
    out = packing.read_pieces(spark, f"{tmp_path}/b").collect()
    assert check_packing(out, rows) <= least + 1 + least // 50
    first = spark.read.parquet(f"{tmp_path}/b/round=0")
    assert 0 < first.where("again").count() < first.count() / 2  # few sequences are packed again
    packing.pack_sequences(frame.where("false"), f"{tmp_path}/e")
    assert packing.read_pieces(spark, f"{tmp_path}/e").count() == 0


def test_sequences_under_tight_constraints_and_a_doc_id_on_all_rows(spark, tmp_path):
    rows = [(7, f"word number {i % 9} " * (1 + i % 50)) for i in range(600)]
    limits = packing.Capacity(512, 3, 40_000, (1.0, 0.2, 0.5), "dot")
    packing.pack_sequences(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/s", limits=limits, pieces_a_block=60)
    out = packing.read_pieces(spark, f"{tmp_path}/s").collect()
    check_packing(out, rows, 200, 3, 40_000, 512)  # a piece of more than 200 tokens costs too much attention


# ---- fill in the middle


def plain_infill(doc_id, text):
    import regex

    text = text or ""
    units = regex.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest, n = sha(f"42:{'' if doc_id is None else doc_id}"), len(units)
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", text, None, None
    if h[3] % 100 < 80:
        return n, "spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid)
    return n, "psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid)


def test_infill_is_the_plain_versions_and_restores_every_text(spark):
    odd = ["", None, " ", "\t\n", "a", " a ", "<P", "a<S b>", "<", "> <P>", "x<M>y", "< S>P>", "é 🙂  x", "<<P <S M>>", "word " * 20_000, " " * 50_000, "x" * 50_000 + " " * 9]
    rows = [(i * 37 + k, t) for k, t in enumerate(odd) for i in range(12)] + [(None, "a b c"), (5, "a b"), (5, "a b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = frame.withColumn("n", F.lit("x")).withColumn("form", F.lit(1)).withColumn("_units", F.lit(1)).withColumn("row", F.lit(1)).withColumn("other", F.lit(9))
    made = infill.fill_in_middle(clashing)
    assert made.columns == ["doc_id", "text", "_units", "row", "other", "n", "form", "fim", "prefix_chars", "middle_chars"]
    out = made.withColumn("back", infill.restore(F.col("fim"), F.col("form"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n, r.form, r.fim, r.prefix_chars, r.middle_chars) == plain_infill(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(frame.where("false")).count() == 0


def test_infill_with_other_sentinels_and_no_python_or_shuffle(spark):
    rules = infill.Infill(seed=1, rate=100, suffix_first=0, prefix="[pre]", suffix="[suf]", middle="[mid]")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = infill.fill_in_middle(docs, rules)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    wrong = made.where((F.col("form") != "psm") | (infill.restore(F.col("fim"), F.col("form"), rules) != F.col("text")))
    assert wrong.where("text <> ''").count() == 0


# ---- licences that contain one another, SPDX lines


def test_two_clauses_within_three_and_spdx_lines_by_rule(spark):
    from lodestone.llm import licenses

    two = next(t for n, t in licenses.TEMPLATES if n == "BSD-2-Clause" and "Redistributions in binary" in t)
    three = max((t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause"), key=len)
    assert licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD).above == {"BSD-2-Clause": ["BSD-3-Clause"]}
    cases = {
        two: "BSD-2-Clause", three: "BSD-3-Clause", f"some words\n\n{two}\n\nother words": "BSD-2-Clause", f"some words\n\n{three}\n\nother words": "BSD-3-Clause",
        "SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "// SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0", "# SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "SPDX-License-Identifier: CC0-1.0": "CC0-1.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "GPL-2.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)": "BSL-1.0",
        "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "nothing of the kind": None, two.split(": 1.")[0] + ":": "BSD-2-Clause",
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.licenses) for r in licenses.scan_licenses(frame).collect()}
    for i, (text, want) in enumerate(cases.items()):
        assert got[i] == (want, [want] if want else []), text
    again = spark.createDataFrame([(1, two), (1, two), (2, None), (3, "")], "doc_id long, text string").withColumn("license_id", F.lit("x"))
    assert sorted((r.doc_id, r.license_id or "-") for r in licenses.scan_licenses(again).collect()) == [(1, "BSD-2-Clause"), (1, "BSD-2-Clause"), (2, "-"), (3, "-")]
    assert licenses.scan_licenses(again.limit(0)).count() == 0
