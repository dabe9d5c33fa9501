"""Query catalog. Importing this package registers every named query."""

from vulnsift.plans.registry import REGISTRY, Query, query  # noqa: F401
from vulnsift.plans import search, text, feed, pairs, collection, attention, extras  # noqa: F401  (order: later plans reuse earlier SQL)
