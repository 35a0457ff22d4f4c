"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from . import intake, merging, reports, search, segments  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "g4_parse_articles"
