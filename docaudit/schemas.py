"""Table schemas of the corpus, its predictions, step cases and reports."""

from __future__ import annotations

ITEM = "struct<type: string, text: string, image_url: struct<url: string>>"

CORPUS = f"""
    paper_id string, title string, paper_category string, error_category string,
    error_location string, error_severity string, error_annotation string,
    paper_content array<{ITEM}>, error_local_content array<{ITEM}>
"""

# In files the id's column may be named after its kind.
CORPUS_FILE = f"`doi/arxiv_id` string, {CORPUS}"

FINDING = (
    "struct<error_category: string, error_location: string, confidence: double,"
    " supporting_evidence: string, verifier_name: string, snippet_id: string>"
)

PREDICTIONS = f"""
    paper_id string, title string, paper_category string,
    predicted_errors array<{FINDING}>, total_snippets bigint, snippets_verified bigint,
    errors_detected bigint, verifier_usage map<string, bigint>
"""

STEP_CASES = """
    id string, generator string, problem string, steps array<string>,
    final_answer_correct boolean, label int, split string
"""

REPORTS = f"""
    paper_id string, title string, paper_category string, verdict string,
    predicted_errors array<{FINDING}>
"""

RAW_ERRORS = (
    "struct<errors: array<struct<error_category: string, error_location: string,"
    " confidence: string, supporting_evidence: string>>>"
)

MATCHES = "array<struct<annotation_index: string, prediction_index: string, reasoning: string>>"
