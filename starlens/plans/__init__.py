"""Named queries over the driver tables (see ``registry``)."""

from starlens.plans import eda, evaluation, io, models, text  # noqa: F401  (register queries)
from starlens.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["QUERIES", "ORACLE_SQL"]
