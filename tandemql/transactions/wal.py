"""The log of decisions: a record is on disk before any participant hears of it.

Records are lines of one local file (DecisionLog), or files of a shared folder with a line each
(SharedDecisionLog), as stores that a cluster shares can't append. Lines are ``COMMIT<tab>id<tab>p1,p2``, ``ROLLBACK<tab>id<tab>p1,p2`` and ``COMPLETE<tab>id``. A decision without
COMPLETE is in doubt. Compaction writes the decisions in doubt to a new file that replaces the log at once.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from tandemql.transactions.shared_files import SharedFiles


@dataclass(frozen=True)
class Decision:
    kind: str
    txn: str
    participants: tuple[str, ...]

    def line(self) -> str:
        return f"{self.kind}\t{self.txn}\t{','.join(self.participants)}\n"


class DecisionLog:
    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def _append(self, line: str) -> None:
        with self.path.open("a") as f:
            f.write(line)
            f.flush()
            os.fsync(f.fileno())

    def _lines(self) -> list[str]:
        """Whole lines, in order; a last line that was cut off is no line."""
        text = self.path.read_text() if self.path.exists() else ""
        return text.split("\n")[:-1]

    def decide(self, kind: str, txn: str, participants: list[str]) -> Decision:
        if kind not in ("COMMIT", "ROLLBACK"):
            raise ValueError(f"no decision {kind}")
        if any(c in x for x in [txn, *participants] for c in "\t\n,"):
            raise ValueError("ids may hold no tab, newline or comma")
        decision = Decision(kind, txn, tuple(participants))
        self._append(decision.line())
        return decision

    def complete(self, txn: str) -> None:
        self._append(f"COMPLETE\t{txn}\n")

    def in_doubt(self) -> list[Decision]:
        """Decisions that aren't complete, in order."""
        found: dict[str, Decision] = {}
        for line in self._lines():
            parts = line.split("\t")
            if parts[0] in ("COMMIT", "ROLLBACK") and len(parts) == 3:
                found[parts[1]] = Decision(parts[0], parts[1], tuple(p for p in parts[2].split(",") if p))
            elif parts[0] == "COMPLETE" and len(parts) == 2:
                found.pop(parts[1], None)
        return list(found.values())

    def compact(self) -> None:
        fresh = self.path.with_suffix(".compact")
        with fresh.open("w") as f:
            f.writelines(d.line() for d in self.in_doubt())
            f.flush()
            os.fsync(f.fileno())
        os.replace(fresh, self.path)


class SharedDecisionLog(DecisionLog):
    """A log whose records are numbered files of a folder."""

    def __init__(self, files: SharedFiles, folder: str = "log"):
        self.files, self.folder = files, folder

    def _names(self) -> list[str]:
        return [n for n in self.files.names(self.folder) if not n.startswith(".")]

    def _append(self, line: str) -> None:
        last = max([int(n) for n in self._names()], default=-1)
        self.files.create(f"{self.folder}/{last + 1:012d}", line)

    def _lines(self) -> list[str]:
        texts = [self.files.read(f"{self.folder}/{n}") for n in self._names()]
        return [t[:-1] for t in texts if t.endswith("\n")]

    def compact(self) -> None:
        """Decisions before their COMPLETE are deleted, so that what a crash leaves is at worst a COMPLETE alone."""
        open_ids = {d.txn for d in self.in_doubt()}
        records = [(n, self.files.read(f"{self.folder}/{n}").rstrip("\n").split("\t")) for n in self._names()]
        for n, parts in sorted(records, key=lambda r: r[1][0] == "COMPLETE"):
            if len(parts) < 2 or parts[1] not in open_ids:
                self.files.delete(f"{self.folder}/{n}")
