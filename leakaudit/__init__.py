"""Information-leakage audits over event and interval data, as Spark jobs."""

from leakaudit.operators.grid import Grid
from leakaudit.session import configure

__all__ = ["Grid", "configure"]
