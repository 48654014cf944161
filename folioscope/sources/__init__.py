"""Readers and writers: corpora, tolerant JSON lines, logs, indexes and reports."""
