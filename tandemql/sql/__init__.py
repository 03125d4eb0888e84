"""The SQL front end: lexing, parsing, printing, digests, classification and lowering to Spark SQL."""

from tandemql.sql.dialect import Dialect

__all__ = ["Dialect"]
