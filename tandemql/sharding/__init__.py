"""Sharded tables: routing by hash, range or list, and pruning by predicates on the key."""
