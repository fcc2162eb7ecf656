"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

#: The memory tables, their columns and keys.
TABLES = {
    "embed_config": ("embed_config_id string, json_payload string, created_at timestamp", ["embed_config_id"]),
    "cluster_config": ("cluster_config_id string, json_payload string, created_at timestamp", ["cluster_config_id"]),
    "llm_config": ("llm_config_id string, provider string, model string, endpoint string, params_json string, created_at timestamp", ["llm_config_id"]),
    "source_snapshot": ("snapshot_id string, source string, period_start string, period_end string, raw_json string, created_at timestamp", ["snapshot_id"]),
    "paper": ("paper_id string, title string, summary string, keywords array<string>, url string, source string, published_at string, ingested_at timestamp", ["paper_id"]),
    "snapshot_paper": ("snapshot_id string, paper_id string", ["snapshot_id", "paper_id"]),
    "paper_embedding": ("paper_id string, embed_config_id string, dim int, vector array<float>, created_at timestamp", ["paper_id", "embed_config_id"]),
    "cluster_run": ("cluster_run_id string, snapshot_id string, embed_config_id string, cluster_config_id string, role string, selected_best boolean, created_at timestamp", ["cluster_run_id"]),
    "cluster": ("cluster_id string, cluster_run_id string, cluster_index bigint, size bigint, centroid array<float>, cohesion double, created_at timestamp", ["cluster_id"]),
    "cluster_member": ("cluster_id string, paper_id string, rank_in_cluster bigint, sim_to_centroid double", ["cluster_id", "paper_id"]),
    "topic": ("topic_id string, canonical_name string, canonical_summary string, labels array<string>, status string, created_at timestamp, updated_at timestamp", ["topic_id"]),
    "topic_embedding": ("topic_id string, embed_config_id string, dim int, vector array<float>, created_at timestamp", ["topic_id", "embed_config_id"]),
    "topic_observation": ("observation_id string, topic_id string, cluster_id string, proposed_name string, proposed_summary string, proposed_labels array<string>, produced_by string, created_at timestamp, llm_config_id string", ["observation_id"]),
    "topic_cluster_link": ("topic_id string, cluster_id string, decision string, match_score double, created_at timestamp", ["topic_id", "cluster_id"]),
    "topic_event": ("event_id string, event_type string, topic_ids array<string>, produced_by string, embed_config_id string, proposal_text string, geometry_check_json string, approved boolean, created_at timestamp, approved_at timestamp, llm_config_id string", ["event_id"]),
    "topic_lineage": ("topic_id string, ancestor_topic_id string, relation string, effective_from string", ["topic_id", "ancestor_topic_id", "relation"]),
    "report": ("report_id string, period_start string, period_end string, cluster_id string, report_md string, created_at timestamp, llm_config_id string", ["report_id"]),
    "report_topic_link": ("report_id string, topic_id string, role string, match_score double, created_at timestamp", ["report_id", "topic_id"]),
    "topic_depth_annotation": ("depth_id string, topic_id string, as_of_date string, depth_level int, rationale string, based_on_report_ids array<string>, produced_by string, created_at timestamp, llm_config_id string", ["depth_id"]),
}

PAPER = "struct<paper_id:string,title:string,summary:string,keywords:array<string>,url:string,published_at:string>"
MEMBER = "struct<paper_id:string,rank_in_cluster:bigint,sim_to_centroid:double>"
CLUSTER = f"struct<cluster_index:bigint,size:bigint,centroid:array<float>,cohesion:double,members:array<{MEMBER}>>"
PAYLOAD = (
    "source string, period_start string, period_end string, snapshot_id string, raw_json string, role string, "
    "embed_config struct<embed_config_id:string,json_payload:string>, cluster_config struct<cluster_config_id:string,json_payload:string>, "
    f"papers array<{PAPER}>, clusters array<{CLUSTER}>"
)
#: A paper of a dump.
PAPER_ITEM = {"id": "string", "title": "string", "summary": "string", "ai_keywords": "array<string>", "publishedAt": "string", "ai_summary": "string"}
DUMP = f"papers map<string, array<struct<paper:struct<{','.join(f'{n}:{k}' for n, k in PAPER_ITEM.items())}>>>>"

#: Tables of a flat payload, without its key ``payload_id``; as typed rows each is a struct of its kind.
FLAT = {
    "payload": "source:string,period_start:string,period_end:string,snapshot_id:string,raw_json:string,role:string,embed_config_id:string,embed_json:string,cluster_config_id:string,cluster_json:string",
    "papers": "pos:bigint,paper_id:string,title:string,summary:string,keywords:array<string>,url:string,published_at:string",
    "clusters": "cluster_index:bigint,size:bigint,centroid:array<float>,cohesion:double",
    "members": "cluster_index:bigint,paper_id:string,rank_in_cluster:bigint,sim_to_centroid:double",
}
FLAT_ROWS = "kind string, payload_id string, " + ", ".join(f"{kind} struct<{fields}>" for kind, fields in FLAT.items())
