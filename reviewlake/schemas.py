"""Schemas of the contract tables, as DDL strings."""

PR_FILES = (
    "review_id string, filename string, status string, additions int, deletions int,"
    " patch string, content string"
)
PR_HEADERS = (
    "number int, title string, body string, state string, html_url string,"
    " head struct<ref string, sha string>,"
    " base struct<ref string, repo struct<name string, owner struct<login string>>>,"
    " additions int, deletions int, changed_files int, labels array<struct<name string>>,"
    " draft boolean,"
    " files array<struct<filename string, status string, additions int, deletions int,"
    " changes int, patch string>>"
)
DELIVERIES = (
    "delivery_id string, event_type string, signature string, body binary, received_at timestamp"
)
PAYLOAD = (
    "action string, pull_request struct<html_url string, number bigint>,"
    " repository struct<full_name string>, ref string"
)
MODEL_REPLY = "summary string, suggestions array<string>, overall_assessment string"
FINDINGS = (
    "file_id bigint, category string, severity string, rule_id string, line_number int,"
    " end_line int, message string, code_snippet string, suggestion string, ordinal bigint"
)
