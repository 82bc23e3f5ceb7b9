"""All registered queries and oracles."""

from depsignal.checks import (  # noqa: F401
    ingest_checks,
    metric_checks,
    package_checks,
    portfolio_checks,
    report_checks,
)
from depsignal.checks.registry import ORACLES, QUERIES  # noqa: F401
