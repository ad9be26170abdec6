"""Operators for preparing training text: filters, deduplication, extraction, search, counting, mixing and scans.

Every operator takes DataFrames and returns one. Nothing else in the package imports this folder; ``queries`` holds
the registered queries and ``oracles`` their DuckDB SQL.
"""
