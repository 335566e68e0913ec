"""Readers: SQLite corpora, CSV of unknown dialect, snapshots, catalogues, digests."""
