"""Shared-folder tables: lineage is cut by a written Parquet table, never by localCheckpoint."""

from __future__ import annotations

from ..tables import shared_dir
from ..tables import shared_table as written

__all__ = ["shared_dir", "written"]
