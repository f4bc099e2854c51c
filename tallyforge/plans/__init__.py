"""Whole queries over the driver's tables, with DuckDB SQL for each."""
