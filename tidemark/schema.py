"""Names, limits and row shapes of the log engine."""

from __future__ import annotations

# Catalogs and limits of the data model.
FORMATS = ["json", "cri", "postgres", "clf", "syslog5424", "syslog", "logfmt", "plain"]
ROLES = ["frontend", "proxy", "gateway", "backend", "worker", "queue", "cache", "db", "external", "unknown"]
LEVELS = ["trace", "debug", "info", "warn", "error", "critical", "fatal"]
MAX_FILES = 32
MAX_FILE_BYTES = 64_000_000
MAX_ENTRIES = 500_000
PASTE_BYTES = 2_000_000
PASTE_ENTRIES = 20_000
DETECT_LINES = 200
MAX_LINE_CHARS = 64_000
MAX_CONTINUATIONS = 200
SKEW_SECONDS = 120

SOURCE = "file_idx int, name string, content string, service string, role string, format string, timezone string, offset_seconds int"

#: One log event. ``attributes`` holds the JSON text of each value, so types and nesting survive in a groupable column.
#: ``timestamp`` is UTC without a session zone; ``seq`` orders the events of a file.
ENTRY_COLUMNS = [
    "file_id", "file_idx", "line_no", "seq", "service", "role", "timestamp", "time_source", "level", "message",
    "trace_id", "span_id", "parent_span_id", "attributes", "correlation_keys", "raw", "template_id", "flow_id",
]
