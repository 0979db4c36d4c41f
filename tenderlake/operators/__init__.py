"""Relational building blocks: search, ranking, rollups, linkage, profiles."""
