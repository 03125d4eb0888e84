"""A two-dialect (MySQL, PostgreSQL) SQL engine on Apache Spark."""

__version__ = "0.1.0"
