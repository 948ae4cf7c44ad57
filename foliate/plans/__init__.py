"""Whole queries: each operator over the test tables, with the same result in DuckDB SQL."""
