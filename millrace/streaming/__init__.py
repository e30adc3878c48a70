"""Structured Streaming twins: stateless reports, completion by count, incremental top-k, one stream for
several reports, joins of streams, tables that are appended to exactly once."""

from .completion import completed_rows, completion_gate
from .joins import completed_join, read_completed_join, stream_completed_join, stream_near_join
from .ledger import completed_keys, read_completed, read_session, ready_sessions, stream_completed, stream_results
from .published import Published, append_stream
from .reports import read_fan_out, read_top_k, stream_fan_out, stream_filter, stream_join, stream_top_k

__all__ = [
    "Published", "append_stream", "completed_join", "completed_keys", "completed_rows", "completion_gate", "read_completed", "read_completed_join",
    "read_fan_out", "read_session", "read_top_k", "ready_sessions", "stream_completed", "stream_completed_join", "stream_fan_out", "stream_filter",
    "stream_join", "stream_near_join", "stream_results", "stream_top_k",
]
