"""Queries over the driver's tables, beside the SQL that they must equal."""

from . import analysis, catalogue, files, language, models, orders, predictors  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
