"""Registered queries, one module per category, each beside its DuckDB SQL."""
