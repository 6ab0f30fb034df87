"""Readers and writers of label text, annotation JSON, run logs and reports."""
