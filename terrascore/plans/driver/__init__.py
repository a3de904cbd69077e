"""Every operator run on the driver tables, each beside its SQL equivalent."""

from terrascore.plans.driver import (  # noqa: F401  (registers the queries)
    cleaning_checks,
    indicator_checks,
    operator_checks,
    scoring_checks,
    source_checks,
)
from terrascore.plans.driver.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
