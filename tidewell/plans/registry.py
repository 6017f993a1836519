"""All queries of the engine; importing the modules registers them."""

from tidewell.plans import claims, ingest, lake, search, sessions, texts  # noqa: F401
from tidewell.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
