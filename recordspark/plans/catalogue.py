"""All queries of the core; importing it registers them."""

from recordspark.plans import auditing, browsing, facade, people, searching, states  # noqa: F401
from recordspark.plans.registry import QUERIES, SQL  # noqa: F401
