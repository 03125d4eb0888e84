"""Transactions over sharded tables: a commit publishes what changed in all shards, or nothing.

Until then a change is a version of its table in the session alone, as with local tables, so that savepoints and
rollbacks keep references. Folders that no manifest or note names are left for ``ShardStore.vacuum``.
"""

from __future__ import annotations

from contextlib import contextmanager

from tandemql.sharding.versions import ShardedVersions
from tandemql.tables import VersionedTable
from tandemql.transactions.local import LocalTransaction
from tandemql.transactions.two_phase import ShardStore, TwoPhaseTransaction
from tandemql.transactions.wal import SharedDecisionLog


class DistributedTransaction(LocalTransaction):
    is_distributed = True

    def __init__(self, tables: dict[str, VersionedTable], store: ShardStore, before: LocalTransaction | None = None):
        super().__init__(tables)
        self.store, self.log = store, SharedDecisionLog(store.files)
        if before is not None:
            self.autocommit, self._begun, self._savepoints = before.autocommit, before._begun, before._savepoints

    def enlist(self, name: str, table: ShardedVersions) -> None:
        """A table that comes in during a transaction is in it as it came."""
        for snapshot in [s for s in (self._begun, *[s for _, s in self._savepoints]) if s is not None]:
            snapshot.setdefault(name, table.version)

    def route_dml(self, table: VersionedTable, shards: set[int] | None) -> VersionedTable:
        return table.only(shards)

    def participants(self) -> dict[str, tuple[list[str], list[str]]]:
        """The shards that the transaction has changed: their folders, and those that are new."""
        out = {}
        for name, table in self.tables.items():
            if isinstance(table, ShardedVersions):
                for s, folders in table.version.folders.items():
                    old = table.published.get(s)
                    if folders != old:
                        out[f"{name}.{s}"] = list(folders), [f for f in folders if f not in (old or ())]
        return out

    def publish(self) -> None:
        changes = self.participants()
        if not changes:
            return
        txn = TwoPhaseTransaction(self.store, self.log)
        for shard, (folders, own) in changes.items():
            txn.point(shard, folders, own)
        txn.commit()
        for table in self.tables.values():
            if isinstance(table, ShardedVersions):
                table.published = dict(table.version.folders)

    def commit(self) -> None:
        self.publish()
        super().commit()

    def rollback(self) -> None:
        if self._begun is not None:
            self._restore(self._begun)
        super().commit()

    @contextmanager
    def statement(self):
        with super().statement():
            yield
            if not self.active:
                self.publish()
