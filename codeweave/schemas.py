"""The tables of an index."""

from __future__ import annotations

FILES = "path string, language string, content_hash string, line_count int, last_indexed timestamp"
SYMBOLS = "id string, file_path string, name string, qualified_name string, kind string, start_line int, end_line int, signature string"
EDGES = "source_id string, target_id string, kind string, resolved boolean"
METRICS = "symbol_id string, in_degree int, out_degree int, betweenness double, pagerank double"
SUMMARIES = "target_id string, target_kind string, summary_text string, model string, generated_at timestamp, is_stale boolean"
RAW_REFS = "source_id string, ref_text string, kind string, file_path string, language string, ordinal int"
CHANGES = "path string, change_type string"

TABLES = {"files": FILES, "symbols": SYMBOLS, "edges": EDGES, "metrics": METRICS, "summaries": SUMMARIES, "raw_refs": RAW_REFS}
KEYS = {"files": ["path"], "symbols": ["id"], "edges": ["source_id", "target_id", "kind"], "metrics": ["symbol_id"], "summaries": ["target_id"]}

# Extensions by language, default excluded directories, thresholds and list lengths of the reports.
LANGUAGES = {".py": "python", ".java": "java", ".ts": "typescript", ".tsx": "tsx"}
EXCLUDED = (".git", "__pycache__", ".venv", "venv", "node_modules", "target", "build", "dist", ".mypy_cache", ".pytest_cache")
GOD_DEGREE = 20
TOP = 10
EXACT_VERTICES = 500
MAX_SUMMARY_CHARS = 100_000
