"""Transactions of one session: a snapshot is the tables' versions, kept by reference."""

from __future__ import annotations

from contextlib import contextmanager

from tandemql.sql.dialect import SqlError
from tandemql.tables import Version, VersionedTable

Snapshot = dict[str, Version]


class LocalTransaction:
    is_distributed = False

    def __init__(self, tables: dict[str, VersionedTable]):
        self.tables = tables
        self.autocommit = True
        self._begun: Snapshot | None = None
        self._savepoints: list[tuple[str, Snapshot]] = []

    @property
    def active(self) -> bool:
        return self._begun is not None

    def _snapshot(self) -> Snapshot:
        return {n: t.version for n, t in self.tables.items()}

    def _restore(self, snapshot: Snapshot) -> None:
        for name, version in snapshot.items():
            if name in self.tables:
                self.tables[name].version = version

    def route_dml(self, table: VersionedTable, shards: set[int] | None) -> VersionedTable:
        """The table as a statement changes it that can touch ``shards`` alone (None: any)."""
        return table

    def begin(self) -> None:
        self.commit()  # an open one is committed first
        self._begun = self._snapshot()

    def commit(self) -> None:
        self._begun, self._savepoints = None, []

    def rollback(self) -> None:
        if self._begun is not None:
            self._restore(self._begun)
        self.commit()

    def savepoint(self, name: str) -> None:
        if not self.active:
            raise SqlError("SAVEPOINT outside a transaction")
        self._savepoints = [s for s in self._savepoints if s[0].lower() != name.lower()]
        self._savepoints.append((name, self._snapshot()))

    def _at(self, name: str) -> int:
        for i, (n, _) in enumerate(self._savepoints):
            if n.lower() == name.lower():
                return i
        raise SqlError(f"no savepoint {name}")

    def rollback_to(self, name: str) -> None:
        at = self._at(name)
        self._restore(self._savepoints[at][1])
        del self._savepoints[at + 1 :]

    def release(self, name: str) -> None:
        del self._savepoints[self._at(name) :]

    @contextmanager
    def statement(self):
        """A statement as a whole: an error in it leaves no change. Without autocommit it opens a transaction."""
        if not self.autocommit and not self.active:
            self._begun = self._snapshot()
        before = self._snapshot()
        try:
            yield
        except Exception:
            self._restore(before)
            raise
