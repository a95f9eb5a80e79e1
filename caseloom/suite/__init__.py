"""Queries over the shared test tables, and the same questions in DuckDB SQL."""
