"""The two dialects and the error that the front end raises."""

from __future__ import annotations

from enum import Enum


class Dialect(str, Enum):
    MYSQL = "mysql"
    POSTGRES = "postgres"

    @classmethod
    def of(cls, name: str | Dialect) -> Dialect:
        text = str(getattr(name, "value", name)).lower()
        aliases = {"mysql": cls.MYSQL, "postgres": cls.POSTGRES, "postgresql": cls.POSTGRES, "pgsql": cls.POSTGRES}
        if text not in aliases:
            raise ValueError(f"unknown dialect {name!r}")
        return aliases[text]


class SqlError(ValueError):
    """A statement that can't be read or that the engine doesn't run."""
