"""Readers and writers: JSONL, Markdown documents, chunk tables, traces, reports."""
