"""The engine's relations as Spark schemas."""

from __future__ import annotations

SOURCES = "id string, kind string, root_uri string, title string, strategy string, status string, meta_json string, created_at timestamp, updated_at timestamp"
DOCUMENTS = (
    "id string, source_id string, uri string, title string, content_hash string, extracted_path string, status string, error string, meta_json string, created_at timestamp, updated_at timestamp"
)
CHUNKS = (
    "id string, document_id string, source_id string, chunk_index int, text string, heading string, section_path string, title string,"
    " start_offset int, end_offset int, content_hash string, kind string, language string"
)
EMBEDDINGS = "chunk_id string, model_id string, dims int, embedding array<float>"
HITS = "chunk_id string, document_id string, source_id string, text string, heading string, section_path string, uri string, title string, score double, kind string"
SECTIONS = "rank int, title string, uri string, heading string, text string, score double, tokens int"
EXTRACTOR_VERSION = 2
