"""Queries of this subpackage, as __spark_entry__ registers them, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, infill, language, licenses, merkle, mixing, neighbours, packing, secrets, sharding, simhash, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": mixing.op1_pareto_mix,
    "op2_chat_format": chat.op2_chat_format,
    "op3_decontaminate": decontamination.op3_decontaminate,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_nearest": neighbours.op5_nearest,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_karmarkar_karp": sharding.op7_karmarkar_karp,
    "op8_simhash": simhash.op8_simhash,
    "op9_token_files": tokens.op9_token_files,
    "op10_language_id": language.op10_language_id,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_vector_best_fit": packing.op12_vector_best_fit,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op1_pareto_mix": mixing.OP1_SQL,
    "op2_chat_format": chat.OP2_SQL,
    "op3_decontaminate": decontamination.OP3_SQL,
    "op4_secret_scan": secrets.OP4_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_fill_in_middle": infill.OP13_SQL,
}
