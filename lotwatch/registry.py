"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from lotwatch.plans import collected, evidence, franchises, intents, kinds, markets, pages, payloads, pricing, readers, references, registry_runs, rules, runs, sources, streams, texts, titles, valuation, views  # noqa: F401
from lotwatch.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
