"""All queries of the engine's own operators."""

from docloom.plans import catalog_explain, catalog_graph, catalog_knowledge, catalog_ops, catalog_search, catalog_text  # noqa: F401
from docloom.plans.registry import QUERIES, SQL  # noqa: F401
