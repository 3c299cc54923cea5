"""Token files, language models and the pipeline."""

import glob
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import language, tokens

SF = "/root/testdata/sf0.001"
EDGE = [None, "", " ", "a", " lead", "trail ", "two  spaces", "line\nbreak. next, \tmix", "it's 'quoted' don't, x.", "é ß, 12,3. <|endoftext|> end", "tab\tone", "　wide  nbsp", "a  b"]


def plain_ids(texts, special_as_text=False):
    plain = Tokenizer.from_file(tokens.tokenizer_path())
    plain.encode_special_tokens = special_as_text
    return [x.ids for x in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(encoder, texts):
    flat, sizes = encoder.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


def test_chunks_give_the_tokenizers_own_ids(spark):
    texts = EDGE + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    texts += ["word " * 60_000, "w" * 30_000, "é" * 9_000 + "\nnext"]
    for special_as_text in (False, True):
        want = plain_ids(texts, special_as_text)
        for cache in (24 << 20, 2000, 0):
            encoder = tokens.ChunkEncoder(tokens.tokenizer_path(), cache, special_as_text)
            assert encoded(encoder, texts) == want
            assert encoded(encoder, texts) == want
            assert encoder._known.nbytes + encoder._values.nbytes <= cache
    assert 50256 in encoded(tokens.ChunkEncoder(tokens.tokenizer_path()), ["a <|endoftext|> b"])[0]


ATOMS = [*"aZé ß1٣²ǅ中́_'.,!?%-\n\t\r\x1c\x85\xa0\u2003", " a", "'s ", "don't", "<|endoftext|>", "🙂"]


@given(st.lists(st.lists(st.sampled_from(ATOMS), max_size=40).map("".join), max_size=8))
@settings(max_examples=60, deadline=None)
def test_any_text_gives_the_tokenizers_own_ids(texts):
    global _fuzzed
    _fuzzed = _fuzzed or tokens.ChunkEncoder(tokens.tokenizer_path())
    assert [encoded(_fuzzed, [t])[0] for t in texts] == plain_ids(texts)


_fuzzed = None


def test_letters_of_the_cut_are_letters_of_the_tokenizer():
    """Words of one letter each, before and after a mark, of every letter that the pattern of simple chunks takes."""
    letters = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    simple = pc.extract_regex(pa.array(letters), tokens._SIMPLE).is_valid().to_pylist()
    texts = [f"a {c}b. {c}, x\n{c}" for c, s in zip(letters, simple, strict=True) if s]
    assert len(texts) > 100_000
    assert encoded(tokens.ChunkEncoder(tokens.tokenizer_path()), texts) == plain_ids(texts)


def test_token_files_round_trip(spark, tmp_path):
    texts = [*EDGE, *(f"text number {i}" for i in range(50))]
    order = np.random.default_rng(5).permutation(len(texts)).tolist()
    frame = spark.createDataFrame([(i, texts[i], 7) for i in order], "doc_id long, text string, n_tokens int").repartition(3)
    tokens.write_tokens(frame, f"{tmp_path}/t")
    at = 0
    rows = {r.doc_id: r for r in tokens.read_digests(spark, f"{tmp_path}/t").collect()}
    for i, own in enumerate(plain_ids(texts)):
        ids = [*own, 0]
        assert (rows[i].start, rows[i].n_tokens) == (at, len(ids))
        assert rows[i].ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    tokens.write_tokens(frame.where("false"), f"{tmp_path}/e")
    assert tokens.read_digests(spark, f"{tmp_path}/e").count() == 0


def test_a_doc_id_with_a_third_of_the_rows_is_dealt_out(spark, tmp_path):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 and i < 200 else i, f"text {i % 9}") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tokens.write_tokens(frame, f"{tmp_path}/t")
    out = tokens.read_digests(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert len(out) == 900 and [r.start for r in out] == np.cumsum([0, *(r.n_tokens for r in out[:-1])]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in out]
    assert ids == sorted(ids)
    hot = spark.read.parquet(f"{tmp_path}/t").where("doc_id = 7").groupBy(F.input_file_name()).count().collect()
    assert len(hot) > 1


def test_files_are_delta_encoded_with_small_row_groups_and_page_indexes(spark, tmp_path):
    texts = [f"some words of document {i} " * (20 + i % 7) for i in range(4000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tokens.write_tokens(frame, f"{tmp_path}/t", row_group_bytes=64 << 10)
    files = sorted(glob.glob(f"{tmp_path}/t/*.parquet"))
    groups, bounds = 0, []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            columns = {group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)}
            ids = next(c for name, c in columns.items() if name.startswith("ids"))
            assert "DELTA_BINARY_PACKED" in ids.encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert ids.has_column_index or columns["doc_id"].has_column_index
            assert columns["doc_id"].has_offset_index and ids.has_offset_index
            bounds.append((columns["doc_id"].statistics.min, columns["doc_id"].statistics.max))
    assert groups > len(files) and sorted(bounds) == bounds
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    wanted = spark.read.parquet(f"{tmp_path}/t").where("doc_id between 100 and 120").select("doc_id", "n_tokens")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert [r.n_tokens for r in wanted.orderBy("doc_id").collect()] == [len(x) + 1 for x in plain_ids(texts[100:121])]


def test_kneser_ney_is_a_distribution():
    model = language.KneserNey({"a": ["the cat sat on the mat", "that hat"], "b": ["und der hund und die katze"]})
    alphabet = sorted(set("the cat sat on the mat that hat und der hund und die katze"))
    for context in ("the", "   ", "xyz", " un"):
        rows = []
        for c in [*alphabet, "Ж"]:
            codes = np.array([ord(x) for x in context + c], dtype=np.uint64)
            rows.append(np.exp2(model.sums(codes)))
        assert np.allclose(np.sum(rows, axis=0), 1, atol=1e-3), context


def naive_kneser_ney(samples):
    """Interpolated Kneser-Ney over dictionaries, straight from the definition: language, normalised text -> log2-probability of its letters."""
    order = language.ORDER
    grams = {name: [[tuple(c[i - n + 1 : i + 1]) for i in range(order - 1, len(c))] for n in range(order + 1)] for name, c in ((k, language.normalise(v).tolist()) for k, v in samples.items())}
    alphabet = {g for x in grams.values() for g in x[1]}

    def model(own):
        counts = [Counter()] * (order + 1)
        counts[order] = Counter(own[order])
        for n in range(order - 1, 0, -1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        total, kinds = defaultdict(int), defaultdict(int)
        for n in range(1, order + 1):
            for g, c in counts[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1

        def p(g):
            if not g:
                return 1 / (len(alphabet) + 1)
            c = counts[len(g)]
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = ones / (ones + 2 * twos) if ones else 0.5
            before = g[:-1]
            if not total[before]:
                return p(g[1:])
            return (max(c[g] - d, 0) + d * kinds[before] * p(g[1:])) / total[before]

        return p

    models = {name: model(x) for name, x in grams.items()}
    return lambda name, codes: sum(np.log2(models[name](tuple(codes[i - order + 1 : i + 1]))) for i in range(order - 1, len(codes)))


def test_scores_are_those_of_a_naive_kneser_ney():
    samples = {"a": "the cat sat on the mat and the hat sat on that cat", "b": "und der hund und die katze sind da", "c": "aaa aab abc"}
    built, naive = language.KneserNey({k: [v] for k, v in samples.items()}), naive_kneser_ney(samples)
    for text in ("the dog sat", "der Hund, die Katze!", "xyzzy ж", "a", "aaab aa", "that the und"):
        codes = language.normalise(text)
        want = [naive(name, codes.tolist()) for name in built.languages]
        assert np.allclose(built.sums(codes), want, rtol=1e-4), text
        names, score, bits, _ = built.identify([text])
        assert names == [built.languages[int(np.argmax(want))]] and abs(bits[0] + max(want) / (len(codes) - 3)) < 1e-3


def test_hundreds_of_languages_are_all_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "TOTAL_CHARS", 20_000)
    rng = np.random.default_rng(8)
    rows = []
    for k in range(450):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6, replace=False)
        rows += [(10 * k + j, " ".join("".join(rng.choice(letters, 4)) for _ in range(40)), f"l{k:03d}") for j in range(4)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == len({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5})
    assert np.isfinite(model.limits).all()


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify_languages(docs)
    both = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    right, total, rejected = both.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert right >= 0.97 * total and rejected <= 0.02 * total
    assert found.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (4, "hello there", None), (5, "the cat " * 4000, "en"), (6, "qqq zzz", "xx")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rejected", F.lit(1)).withColumn("score", F.lit("s"))
    out = {r.doc_id: r for r in language.identify_languages(frame).collect()}
    assert len(out) == 6 and [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    kept = language.drop_rejected(frame)
    assert kept.schema == frame.schema and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3})
    assert language.identify_languages(frame.where("false")).count() == 0
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify_languages(unlabelled).collect()} == {"und"}


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


@pytest.mark.parametrize("kind", ["null", "empty"])
def test_pipeline_stages_on_odd_tables(spark, kind):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "a", 0), (2, "", None, "a", 0)]
    docs = spark.createDataFrame(rows, schema) if kind == "null" else spark.createDataFrame([], schema)
    # the last texts are rejected as no language, in the stages after it the blank texts are one group
    want = {"null": [0, 1, 4, 0, 4], "empty": [0] * 5}[kind]
    assert [stage(spark, docs, SF).count() for _, stage in corpus_pipeline.STAGES] == want


def test_rejection_keeps_mixed_languages_and_drops_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {lang: docs.where(f"lang = '{lang}' and n_chars > 1500").orderBy("doc_id").first().text for lang in ("en", "fr", "de")}
    rng = np.random.default_rng(6)
    noise = "".join(rng.choice(list("bcdfghjklmnpqrstvwxzéßñ "), 2000))
    rows = [(10**9, texts["en"][:700] + texts["de"][:700]), (10**9 + 1, texts["fr"][:900] + texts["en"][:500]), (10**9 + 2, noise)]
    extra = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    found = language.identify_languages(docs.select("doc_id", "text", "lang").unionByName(extra)).where("doc_id >= 1000000000").collect()
    assert {r.doc_id - 10**9: r.rejected for r in found} == {0: False, 1: False, 2: True}


def test_rejection_drops_short_foreign_texts_and_hex_dumps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    foreign = {
        "it": "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. Ahi quanto a dir qual era e cosa dura esta selva selvaggia e aspra e forte",
        "pt": "As armas e os barões assinalados que da ocidental praia lusitana por mares nunca de antes navegados passaram ainda além da Taprobana, em perigos e guerras esforçados mais do que prometia",
        "la": "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation",
        "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "hex": "".join(np.random.default_rng(3).choice(list("0123456789abcdef"), 4000)),
    }
    texts = [t[:n] for t in foreign.values() for n in (50, 100, 150, 4000)]
    extra = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    found = language.identify_languages(docs.unionByName(extra))
    assert found.where("doc_id >= 1000000000 and not rejected").count() == 0
    assert found.where("doc_id < 1000000000 and rejected and lang_pred <> 'und'").count() <= 0.002 * docs.count()


def test_languages_with_few_or_very_long_documents_reject_too(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = "".join(np.random.default_rng(0).choice(list("0123456789abcdef"), 4000))
    ids = [i for i in range(10**9, 10**9 + 50) if zlib.crc32(str(i).encode()) % 5]
    long = docs.where("lang = 'en' and length(text) > 1500").orderBy("doc_id").first().text
    rows = [(ids[0], junk, "zz"), (ids[1], "".join(np.random.default_rng(9).choice(list("abcdefghijklmnopqrstuvwxyz "), 4000)), "yy")]
    model = language.train(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert {"yy", "zz"} < set(model.languages) and np.isfinite(model.limits).all()
    one = language.train(spark.createDataFrame([(ids[2], long * 700, "en"), (ids[3], long, "en"), (ids[4], "ab", "xx")], "doc_id long, text string, lang string"))
    assert np.isfinite(one.limits).all() and one.identify([long])[3].tolist() == [False]
    assert one.identify(["Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar."])[3].tolist() == [True]
