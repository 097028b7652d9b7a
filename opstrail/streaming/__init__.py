from opstrail.streaming.streams import (
    compact_in_place,
    compact_parts,
    read_applied,
    read_slow_table,
    stream_apply,
    stream_new_content,
    stream_slowlog,
)

__all__ = [
    "compact_in_place", "compact_parts", "read_applied", "read_slow_table", "stream_apply",
    "stream_new_content", "stream_slowlog",
]
