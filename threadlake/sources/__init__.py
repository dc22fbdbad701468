"""Landed archive files and stored tables."""

from .archive import (
    landed_archive,
    landed_records,
    rows_by_subreddit,
    scan_page,
    scan_window,
    spread,
    thread_scan,
)
from .landing import Landing
from .store import Store

__all__ = [
    "Landing",
    "Store",
    "landed_archive",
    "landed_records",
    "rows_by_subreddit",
    "scan_page",
    "scan_window",
    "spread",
    "thread_scan",
]
