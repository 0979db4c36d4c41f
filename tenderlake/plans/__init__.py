"""Domain views over the given tables, named tools and the query registry."""
