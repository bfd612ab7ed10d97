"""Queries over the given tables: each module has QUERIES (name -> callable) and SQL (name -> the same in SQL)."""
