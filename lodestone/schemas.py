"""Table schemas of the graph store, and its enumerated domains in their sort order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVENANCE = "array<struct<source_type:string,repo:string,ref:string,url:string,excerpt:string,analyzed_at:string>>"

#: Column names and types of the stored tables.
TABLES = {
    "repos": "id string, name string, remote_url string, local_path string, default_branch string, exclude_dirs array<string>, last_commit_sha string, last_indexed_at timestamp, overview string, created_at timestamp, updated_at timestamp",
    "entities": "id string, repo_id string, kind string, name string, qualified_name string, path string, summary string, capabilities array<string>, assumptions array<string>, name_normalized string, signature string, typeref string, start_line int, end_line int, summary_embedding array<float>, created_at timestamp, updated_at timestamp",
    "facts": f"id string, entity_id string, repo_id string, claim string, dimension string, category string, confidence string, provenance {PROVENANCE}, embedding array<float>, superseded_by string, created_at timestamp, updated_at timestamp",
    "decisions": f"id string, repo_id string, summary string, description string, rationale string, alternatives array<struct<description:string,rejected_because:string>>, tradeoffs array<string>, provenance {PROVENANCE}, made_at timestamp, still_valid boolean, created_at timestamp, updated_at timestamp",
    "decision_entities": "decision_id string, entity_id string",
    "relationships": f"id string, repo_id string, from_entity_id string, to_entity_id string, kind string, description string, strength string, confidence float, provenance {PROVENANCE}, created_at timestamp",
    "cross_repo_relationships": f"id string, from_repo_id string, to_repo_id string, from_entity_id string, to_entity_id string, kind string, description string, strength string, confidence float, provenance {PROVENANCE}, created_at timestamp",
    "execution_flows": "id string, repo_id string, entry_entity_id string, label string, step_entity_ids array<string>, step_names array<string>, depth int, created_at timestamp, updated_at timestamp",
    "fact_feedback": "id string, fact_id string, repo_id string, reason string, correction string, status string, outcome string, created_at timestamp, resolved_at timestamp",
    "extraction_jobs": "id string, repo_id string, phase string, target string, content_hash string, status string, error_message string, tokens_used int, cost_usd decimal(10,6), model_used string, attempt_count int, started_at timestamp, completed_at timestamp, created_at timestamp, updated_at timestamp",
    "indexing_runs": "id string, repo_id string, commit_sha string, mode string, model_extraction string, model_synthesis string, concurrency int, files_total int, files_analyzed int, files_skipped int, entities_created int, facts_created int, rels_created int, decisions_created int, orphan_entities int, backfill_facts int, backfill_rels int, parse_fallbacks int, unresolved_refs int, total_tokens int, total_cost_usd decimal(10,6), quality_overall decimal(5,2), quality_entity_cov decimal(5,2), quality_fact_density decimal(5,2), quality_rel_connect decimal(5,2), quality_dim_coverage decimal(5,2), quality_parse_rate decimal(5,2), duration_ms bigint, started_at timestamp, completed_at timestamp, created_at timestamp",
}

#: Domains in declaration order, which is their sort order.
DOMAINS = {
    "entity_kind": ("module", "service", "function", "type", "endpoint", "concept", "config", "cluster"),
    "dimension": ("what", "how", "why", "when"),
    "category": ("behavior", "constraint", "pattern", "convention", "debt", "risk", "contract"),
    "confidence": ("high", "medium", "low"),
    "relationship_kind": ("depends_on", "calls", "implements", "extends", "produces", "consumes", "replaced_by", "tested_by", "configured_by", "owns", "member_of", "imports"),
    "strength": ("strong", "moderate", "weak"),
    "job_status": ("pending", "in_progress", "completed", "failed", "skipped"),
    "job_phase": ("phase1", "phase2", "phase4", "phase5", "gitlog", "embedding", "phase3", "phase6"),
}

#: Keys that upserts and checks hold unique.
KEYS = {
    "repos": ("local_path",),
    "entities": ("repo_id", "qualified_name"),
    "relationships": ("repo_id", "from_entity_id", "to_entity_id", "kind"),
    "cross_repo_relationships": ("from_entity_id", "to_entity_id", "kind"),
    "extraction_jobs": ("repo_id", "phase", "target"),
    "execution_flows": ("repo_id", "entry_entity_id"),
    "decision_entities": ("decision_id", "entity_id"),
}


def ordinal(domain: str, value: Column) -> Column:
    """Where ``value`` stands in its domain, from 1; null if it is not in it."""
    found = F.array_position(F.array(*[F.lit(x) for x in DOMAINS[domain]]), value)
    return F.when(found > 0, found)


def in_domain(domain: str, value: Column, default: str) -> Column:
    """The value trimmed and lower-cased if the domain has it, else ``default``."""
    tidy = F.lower(F.trim(value))
    return F.when(tidy.isin(*DOMAINS[domain]), tidy).otherwise(F.lit(default))
