"""All registered queries of the library, with their oracle SQL."""

from __future__ import annotations

from .plans import code, corpus, registry, reports, star, structure, whole

MODULES = (code, corpus, reports, star, structure, whole)
QUERIES, ORACLES, FLAGSHIP = registry.QUERIES, registry.ORACLES, registry.FLAGSHIP
