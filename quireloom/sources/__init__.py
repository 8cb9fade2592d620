"""Readers: tables by name, JSON lines, books and page archives."""

from quireloom.sources.tables import read_table, with_text

__all__ = ["read_table", "with_text"]
