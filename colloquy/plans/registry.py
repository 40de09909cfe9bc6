"""All registered queries with their SQL, gathered from the catalog modules."""

from colloquy.plans import catalog_builds, catalog_more, catalog_text, oracle_builds, oracle_more, oracle_text  # noqa: F401  (each registers its part)
from colloquy.plans.catalog import QUERIES
from colloquy.plans.oracle import ORACLE

__all__ = ["QUERIES", "ORACLE"]
