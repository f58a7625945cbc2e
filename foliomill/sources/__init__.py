"""Readers and parsers: parquet tables, markdown, HTML, CSV, JSON, XML."""
