"""JSONL and CSV exports, one folder per community."""

from .exports import append_jsonl, append_trees, write_csv, write_threads

__all__ = ["append_jsonl", "append_trees", "write_csv", "write_threads"]
