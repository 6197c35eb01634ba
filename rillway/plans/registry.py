"""Everything that is registered: the catalogue and the modules that add to it."""

from __future__ import annotations

from rillway.plans import fleet
from rillway.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "fleet"]
