"""Operators on event streams; those without state of their own also run on bounded tables."""

from sparkloom.streaming.state import first_seen, running_totals, unanswered, use_rocksdb
from sparkloom.streaming.windows import deduplicated, drain, event_time, follow_ups, session_counts, sliding, tumbling

__all__ = ["deduplicated", "drain", "event_time", "first_seen", "follow_ups", "running_totals", "session_counts", "sliding", "tumbling", "unanswered", "use_rocksdb"]
