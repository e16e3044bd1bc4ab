"""Options and constants that define what the engine computes."""

from __future__ import annotations

from dataclasses import dataclass, field

# Languages by suffix, document suffixes, folders that are not walked.
CODE_SUFFIXES = {".py": "python", ".java": "java", ".js": "javascript", ".ts": "typescript", ".go": "go", ".cs": "csharp"}
DOCUMENT_SUFFIXES = (".pdf", ".docx", ".md", ".txt", ".html")
SKIPPED_FOLDERS = (".git", ".gradle", ".idea", ".mvn", ".venv", "__pycache__", "build", "dist", "node_modules", "target", "venv")


@dataclass(frozen=True)
class EngineConfig:
    """One analysis. Paths that are absent switch their stage off."""

    code_roots: tuple[str, ...] = ()
    document_folder: str | None = None
    trace_files: tuple[str, ...] = ()
    repository: str | None = None
    labels_file: str | None = None
    feedback_path: str | None = None
    output: str | None = None

    saved_model: str | None = None  # folder of a model to rank by where there are too few labels to train one
    as_of: float | None = None  # epoch seconds of "now"; None: of the run
    # Limits, weights and tree settings that define the results.
    max_features: int = 5000
    strong_coupling: int = 5
    max_commits: int = 1000
    max_days: int = 365
    min_cochange: int = 3
    min_order: int = 3
    lead_window_days: int = 7
    trace_window: int = 5
    half_life_days: float = 90.0
    max_commit_files: int = 100
    weights: dict[str, float] = field(default_factory=lambda: {"structural": 0.40, "behavioral": 0.35, "evolutionary": 0.25})
    adaptive_alpha: float = 0.5
    adaptive_min_labels: int = 5
    cross_layer_bonus: float = 0.15
    neighbours: int = 50
    min_cosine: float = 0.05
    min_training: int = 20
    trees: int = 200
    depth: int = 4
    step: float = 0.05
    subsample: float = 0.8
    patience: int = 20  # trees without a better validation loss before boosting stops
    seed: int = 42
    cluster_size: int = 3
    cluster_samples: int = 2
    pivots: int = 50
    top_k: int = 20
    register_all_modules: bool = False  # classless modules as import targets too
    inheritance_edges: bool = False
    otel_parent_calls: bool = False
    spring_http: bool = False
