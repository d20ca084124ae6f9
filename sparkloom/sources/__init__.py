"""Readers and writers."""

from sparkloom.sources.scratch import settled_table, shared_path
from sparkloom.sources.shards import manifest, ranked, read_shards, write_shards
from sparkloom.sources.tables import FORMATS, TABLES, bucketed, read, read_table, register_views, stream, write

__all__ = ["FORMATS", "TABLES", "bucketed", "manifest", "ranked", "read", "read_shards", "read_table", "register_views", "settled_table", "shared_path", "stream", "write", "write_shards"]
