"""Schemas of the tables; every read names its schema, nothing is inferred. Empty strings mean "absent" in CSV."""

from __future__ import annotations

from .functions.vocabulary import AUDIT_COLUMNS, BASE_COLUMNS

COUNTIES = "county string, seat string, batch string, homepage string"
TARGETS = ", ".join(f"{c} string" for c in BASE_COLUMNS + AUDIT_COLUMNS)
DRAFT = ", ".join(f"{c} string" for c in BASE_COLUMNS)
HOMEPAGES = "county string, seat string, homepage string, confidence string, evidence string, flag_for_review string"
CAPTURES = "requested_url string, run timestamp, path string, http2 boolean, attempt int, ok boolean, html string, final_url string, redirect_chain array<string>, http_status int, content_type string, error string, fetched_at timestamp"
SNAPSHOTS = "county string, page_type string, requested_url string, final_url string, redirect_chain array<string>, http_status int, content_type string, render_mode string, external boolean, fetched_at timestamp, html_sha256 string, text_sha256 string, byte_size long, title string, error string"
CHECKPOINT = "target_key string"
