"""Transactions: local snapshots, a write-ahead log, and two-phase commit over shards."""
