"""Driver queries: the library's operators applied to the given star-schema tables."""

from statledger.queries import (  # noqa: F401  (each module registers its queries)
    adhoc,
    audits,
    jobs,
    keys,
    marts,
    merges,
    quality,
    scans,
    values,
    warehouse,
)
from statledger.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
