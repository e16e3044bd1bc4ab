"""Column names and schemas that more than one operator relies on."""

from __future__ import annotations

# The 19 features of a pair, in the order of the feature vector.
FEATURES = (
    "structural_coupling_weight",
    "tfidf_cosine_similarity",
    "semantic_similarity",
    "shared_import_count",
    "shared_annotation_count",
    "inheritance_linked",
    "runtime_call_frequency",
    "runtime_call_depth",
    "temporal_affinity",
    "execution_order_stability",
    "co_change_frequency",
    "co_change_recency",
    "logical_coupling_score",
    "change_sequence_directionality",
    "pagerank_a",
    "pagerank_b",
    "betweenness_a",
    "betweenness_b",
    "cross_layer_flag",
)

UNITS = "unit_idx bigint, unit_id string, file_path string, language string, package string, class_names array<string>, method_names array<string>, imports array<string>, annotations array<string>, raw_tokens array<string>, domain_hints array<string>, comments string, cyclomatic_complexity double, loc bigint"
EDGES = "source string, target string, kind string, weight bigint"
CHUNKS = "source_file string, chunk_no int, text string, doc_type string"
TRACE_EVENTS = "file string, seq bigint, ts bigint, component string, target string, depth int"
COMMITS = "sha string, parent string, committed_ts bigint, author string, message string"
COMMIT_FILES = "sha string, path string"
LABELS = "comp_a string, comp_b string, label int"
FEEDBACK = "comp_a string, comp_b string, label int, boundary_score double, confidence double, rationale_text string, decided_by string, decided_at string, run_id string, seq bigint, deleted boolean"
