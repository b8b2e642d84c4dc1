"""The queries of the library's own operators and their SQL."""

from __future__ import annotations

from mnemos.plans import commits, layout, lookups, queries, raster, releases, sampling, scalars, states, storage, sync  # noqa: F401  (each registers its queries)
from mnemos.plans.base import ORACLE as SQL
from mnemos.plans.base import QUERIES

FLAGSHIP = "a05_module_progress"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
