"""Two-phase commit over shards that are folders of Parquet.

A shard's manifests are numbered files; the last whole one names the folders of its current data. *Prepare* writes a shard's
next data to a folder of its own, after a note that says which folders the shard will have; the *decision* is a
record of the log; *commit* writes the next manifest from the note; *complete* closes the decision. Data are never
moved, and the only step that must be atomic is that a manifest appears whole, for which its text ends with a line break.
Recovery does again what the log decided, and undoes what was noted without a decision; doing so twice
changes nothing. One driver writes at a time.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tandemql.transactions.shared_files import SharedFiles
from tandemql.transactions.wal import DecisionLog, SharedDecisionLog


class ShardStore:
    """Shards below one base, which driver and executors share."""

    def __init__(self, spark: SparkSession, base: str | Path):
        self.spark, self.files = spark, SharedFiles(spark, str(base))

    def _manifests(self, shard: str) -> list[str]:
        return [n for n in self.files.names(f"shards/{shard}/manifests") if not n.startswith(".")]

    def current(self, shard: str) -> list[str] | None:
        """The folders of the shard's data, or None for a shard that has never been written."""
        for name in reversed(self._manifests(shard)):
            text = self.files.read(f"shards/{shard}/manifests/{name}")
            if text.endswith("\n"):
                return json.loads(text)["data"]
        return None

    def read(self, shard: str) -> DataFrame | None:
        folders = self.current(shard)
        return self.spark.read.parquet(*[self.files.url(f) for f in folders]) if folders else None

    def note(self, shard: str, txn: str, folders: list[str], own: list[str]) -> None:
        """Say what the shard's data are once ``txn`` commits, and which folders are the transaction's own."""
        self.files.create(f"shards/{shard}/staged/{txn}", json.dumps({"data": folders, "own": own}) + "\n")

    def stage(self, shard: str, txn: str, df: DataFrame) -> None:
        """The shard's next data, whole."""
        folder = f"data/{txn}-{shard}"
        self.note(shard, txn, [folder], [folder])
        df.write.parquet(self.files.url(folder))

    def staged(self, shard: str) -> list[str]:
        return [n for n in self.files.names(f"shards/{shard}/staged") if not n.startswith(".")]

    def publish(self, shard: str, txn: str) -> None:
        """Make the noted folders the current ones. Done again, or without a note, nothing happens."""
        if txn not in self.staged(shard):
            return
        folders = json.loads(self.files.read(f"shards/{shard}/staged/{txn}"))["data"]
        if self.current(shard) != folders:
            last = max([int(n) for n in self._manifests(shard)], default=-1)
            self.files.create(f"shards/{shard}/manifests/{last + 1:012d}", json.dumps({"data": folders}) + "\n")
        self.files.delete(f"shards/{shard}/staged/{txn}")

    def discard(self, shard: str, txn: str) -> None:
        if txn not in self.staged(shard):
            return
        text = self.files.read(f"shards/{shard}/staged/{txn}")
        for folder in json.loads(text)["own"] if text.endswith("\n") else []:
            self.files.delete(folder)
        self.files.delete(f"shards/{shard}/staged/{txn}")

    def shards(self) -> list[str]:
        return self.files.names("shards")

    def vacuum(self) -> list[str]:
        """Delete the data that no shard's current manifest and no note names. No transaction may be open, and no older frame in use."""
        named: set[str] = set()
        for shard in self.shards():
            named |= set(self.current(shard) or ())
            for txn in self.staged(shard):
                named |= set(json.loads(self.files.read(f"shards/{shard}/staged/{txn}"))["data"])
        tops = {"/".join(f.split("/")[:2]) for f in named}
        gone = [f"data/{n}" for n in self.files.names("data") if f"data/{n}" not in tops]
        for folder in gone:
            self.files.delete(folder)
        return gone


class TwoPhaseTransaction:
    """Changes of several shards that all happen or don't. It has no savepoints."""

    def __init__(self, store: ShardStore, log: DecisionLog | SharedDecisionLog):
        self.store, self.log = store, log
        self.txn = uuid.uuid4().hex[:16]
        self.changes: dict[str, DataFrame | tuple[list[str], list[str]]] = {}
        self.state = "active"

    def write(self, shard: str, df: DataFrame) -> None:
        """The shard's next data, whole."""
        self._active()
        self.changes[shard] = df

    def point(self, shard: str, folders: list[str], own: list[str]) -> None:
        """The shard's next data, by folders that are written already; ``own`` are gone if the transaction fails."""
        self._active()
        self.changes[shard] = (folders, own)

    def _active(self) -> None:
        if self.state != "active":
            raise RuntimeError(f"the transaction is {self.state}")

    def prepare(self) -> None:
        try:
            for shard, change in self.changes.items():
                if isinstance(change, DataFrame):
                    self.store.stage(shard, self.txn, change)
                else:
                    self.store.note(shard, self.txn, *change)
        except Exception:
            self.rollback()
            raise
        self.state = "prepared"

    def commit(self) -> None:
        if self.state == "active":
            self.prepare()
        if self.state != "prepared":
            raise RuntimeError(f"the transaction is {self.state}")
        self.log.decide("COMMIT", self.txn, list(self.changes))
        self.state = "committed"
        for shard in self.changes:
            self.store.publish(shard, self.txn)
        self.log.complete(self.txn)

    def rollback(self) -> None:
        if self.state == "committed":
            raise RuntimeError("the transaction is committed")
        for shard in self.changes:
            self.store.discard(shard, self.txn)
        self.state = "rolled back"


def recover(store: ShardStore, log: DecisionLog | SharedDecisionLog) -> list[str]:
    """Finish what the log decided and drop what was noted without a decision. Returns the transactions finished."""
    done = []
    for decision in log.in_doubt():
        for shard in decision.participants:
            (store.publish if decision.kind == "COMMIT" else store.discard)(shard, decision.txn)
        log.complete(decision.txn)
        done.append(decision.txn)
    for shard in store.shards():
        for txn in store.staged(shard):
            store.discard(shard, txn)
    log.compact()
    return done
