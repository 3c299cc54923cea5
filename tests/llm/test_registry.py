"""The registered queries: names and types of their columns, one row a document where the contract says so."""

import pytest

from lodestone.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pareto_mix": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
    "op2_chat_format": [("conv_id", "bigint"), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint")],
    "op3_decontaminate": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")],
    "op4_secret_scan": [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")],
    "op5_nearest": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")],
    "op6_license_scan": [("doc_id", "bigint"), ("license_id", "string"), ("dice", "double"), ("licenses", "string")],
    "op7_karmarkar_karp": [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")],
    "op8_simhash": [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")],
    "op9_token_files": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op11_merkle_manifest": [("doc_id", "bigint"), ("leaf", "string"), ("subroot", "string"), ("root", "string"), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean")],
    "op12_vector_best_fit": [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")],
    "op13_fill_in_middle": [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")],
    "op10_language_id": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_of_a_query(spark, name):
    assert registry.QUERIES.keys() == COLUMNS.keys()
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = registry.QUERIES[name](spark, SF)
    assert out.dtypes[: len(COLUMNS[name])] == COLUMNS[name]
    if COLUMNS[name][0][0] == "doc_id" and name != "op12_vector_best_fit":
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch  # no query changes the session
