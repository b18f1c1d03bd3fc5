"""Readers, writers, test fixtures and synthetic tables."""

from tablewise.sources.io import (read_csv, read_table, load_tables, preview, write_cleaned,
                                  write_clusters, save_model, load_model, append_rows, sample_rows)

__all__ = ["read_csv", "read_table", "load_tables", "preview", "write_cleaned", "write_clusters",
           "save_model", "load_model", "append_rows", "sample_rows"]
