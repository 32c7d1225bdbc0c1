"""Parameters, candidate field names and keyword lists shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Names and keywords that decide which rows are findings.
# ---------------------------------------------------------------------------

HOST_FIELDS = ("host", "src", "hostname")
ERROR_CODE_FIELDS = ("error_code", "event_code", "EventCode")
LEVEL_FIELDS = ("severity", "level", "log_level")
QUERY_FIELDS = ("query", "search", "spl", "_raw")
PATH_FIELDS = ("uri", "url", "path", "endpoint")
STATUS_FIELDS = ("status", "status_code", "http_status", "response_code", "statuscode")
DURATION_FIELDS = (
    "duration_ms", "duration", "elapsed", "elapsed_ms",
    "response_time", "run_time", "query_time", "latency", "latency_ms",
)
NUMERIC_FIELDS = (
    "duration_ms", "duration", "elapsed", "response_time",
    "bytes", "bytes_out", "bytes_in", "status", "response_code",
)
THREAD_COUNT_FIELDS = ("active_threads", "thread_count", "pool_active", "active_connections")
LATENCY_FIELDS = ("response_time", "latency_ms", "duration_ms", "elapsed_ms")
CERT_FIELDS = (
    "cert_expiry", "cert_issuer", "cert_serial", "cert_subject", "chain_depth",
    "ocsp_status", "revocation_reason", "tls_error", "tls_version",
)
PROMOTED_FIELDS = ("host", "sourcetype", "source", "app", "_time", "_raw")

SEVERITY_LEVELS = ("CRITICAL", "ERROR", "WARN", "WARNING", "INFO", "DEBUG")

CERT_KEYWORDS = (
    "ocsp", "crl", "chain validation", "handshake failed",
    "revocation", "certificate expired", "cert expired",
)
THREAD_EXHAUSTION_KEYWORDS = (
    "threadpoolexecutor",
    "rejectedexecutionexception",
    "pool exhausted",
    "pool is exhausted",
    "queue full",
    "queue capacity",
    "max threads",
    "maxthreads",
    "thread starvation",
    "no available threads",
    "connection pool exhausted",
    "timeout waiting for connection",
    "timeout waiting for idle object",
    "too many open files",
    "socket accept queue",
    "backlog exceeded",
    "cannot accept connection",
)
SOCKET_STATES = ("close_wait", "syn_recv", "time_wait")
GC_KEYWORDS = ("full gc", "stop-the-world", "gc pause", "allocation stall")


@dataclass(frozen=True)
class PairPattern:
    """Entity-keyed "first, then second" rule; both patterns are lower-case substrings."""

    entity_field: str
    first_pattern: str
    second_pattern: str
    maxspan_seconds: int = 3600


PAIR_PATTERNS = (
    PairPattern("host", "ocsp", "handshake failed", 3600),
    PairPattern("host", "crl", "handshake failed", 3600),
)

@dataclass(frozen=True)
class Params:
    """Every threshold in one place; operators take the values explicitly."""

    spike_window_seconds: int = 60
    spike_threshold: int = 10
    correlate_window_seconds: int = 60
    pair_patterns: tuple[PairPattern, ...] = PAIR_PATTERNS
    cert_keywords: tuple[str, ...] = CERT_KEYWORDS
    slow_threshold_ms: float = 1000
    anomaly_window: int = 20
    anomaly_z_threshold: float = 3.0
    saturation_window_seconds: int = 300
    growth_ratio: float = 1.5
    backlog_min_count: int = 5
    max_iterations: int = 3
    watch_interval_seconds: int = 60
    watch_lookback: str = "-15m"
    watch_overlap_seconds: int = 30


DEFAULTS = Params()
