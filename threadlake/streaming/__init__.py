"""Following newly landed files with Structured Streaming."""

from .tail import dedup_within_watermark, follow_tail, run_tail, tail_rows

__all__ = ["dedup_within_watermark", "follow_tail", "run_tail", "tail_rows"]
