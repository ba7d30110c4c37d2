"""Every operator as a query over the given tables, with the SQL that must agree with it."""

from driver_queries import (  # noqa: F401  (importing registers the queries)
    cleaning, explanation, filters, joins, model, reporting, review, rules, scalars,
)
from driver_queries.base import ORACLES, QUERIES  # noqa: F401
