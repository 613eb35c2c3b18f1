"""All catalog queries and their comparison SQL."""

from docaudit.plans import catalog_checks, catalog_corpus, catalog_eval, catalog_io, catalog_math  # noqa: F401
from docaudit.plans import catalog_scale  # noqa: F401, E402  reuses the SQL of the others
from docaudit.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
