"""Query plans over the given tables: fixture views and the query registry."""
