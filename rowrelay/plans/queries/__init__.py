"""All registered queries: importing the modules fills the registry."""

from rowrelay.plans.queries import addressing, batch, bitmaps, fetch, ingest, status, streams  # noqa: F401
from rowrelay.plans.queries.registry import ORACLES, QUERIES as _REGISTERED

QUERIES = dict(sorted(_REGISTERED.items()))

__all__ = ["ORACLES", "QUERIES"]
