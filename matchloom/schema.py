"""Schemas of the tables that the plan reads and writes."""

from __future__ import annotations

LINES = "doc_id string, line_no int, page_no int, local_line_no int, text string, is_empty boolean"
SENTENCES = "doc_id string, sent_no int, text string, source_lines array<int>"
BLOCKS = (
    "doc_id string, block_no int, text string, section string, source_lines array<int>, position double, topic_boundary boolean, sentences array<struct<text:string,source_lines:array<int>>>, "
    "reclassified_from_other boolean, secondary_section string, inferred_section string, confidence double, review_flag boolean"
)
HEADINGS = "doc_id string, line_no int, section string, heading_text string, confidence double, method string"
FILES = "path string, file_name string, sanitized_name string, format string, length bigint, status string, messages array<string>"
STRENGTHS = ("strong", "moderate", "weak", "none")
