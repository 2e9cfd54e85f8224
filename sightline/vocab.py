"""Names and constants that outside data and readers depend on."""

# Categories a row may be given.
CATEGORIES = [
    "Movies",
    "Television",
    "Games",
    "Music",
    "Applications",
    "Anime",
    "Documentaries",
    "Other",
    "Unwanted",
]
FALLBACK_CATEGORY = "Other"
MALFORMED = "MALFORMED"

# Job states and failure names.
JOB_STATES = ["pending", "verifying", "verified", "failed", "dead"]
BACKLOG_STATES = ["pending", "verifying", "failed"]
JOB_ERRORS = ["sha1_mismatch", "no_peers", "source_timeout", "no_metadata"]
MAX_RETRIES = 4
RETRY_BASE_SECONDS = 60
RETRY_TABLE_SECONDS = [60, 300, 1800, 7200, 43200]
RETRY_BEYOND_TABLE_SECONDS = 365 * 86400

# Marker row written at each start, and the counters of one snapshot.
SESSION_MARKER = "_session_start"
METRIC_NAMES = [
    "inbound_ping",
    "inbound_find_node",
    "inbound_get_peers",
    "inbound_announce_peer",
    "inbound_invalid",
    "inbound_find_node_bep42",
    "inbound_find_node_random",
    "inbound_get_peers_bep42",
    "inbound_get_peers_random",
    "inbound_announce_bep42",
    "inbound_announce_random",
    "inbound_announce_invalid_token",
    "tokens_issued",
    "infohashes_harvested",
    "unique_infohashes",
    "outbound_queries",
    "outbound_timeouts",
    "tx_table_len",
    "routing_table_len",
    "verify_attempts",
    "verify_success",
    "verify_fail",
    "verify_timeouts",
    "fetch_attempts",
    "source_queries",
    "source_responses",
    "source_peers_returned",
    "send_dropped",
    "source_timeout",
    "source_no_peers",
    "source_all_timeout",
    "fetch_connect_timeout",
    "fetch_connect_io",
    "fetch_handshake",
    "fetch_no_extension",
    "fetch_reject",
    "fetch_bad_piece",
    "fetch_io",
    "sha1_mismatch",
    "peer_cache_size",
    "peer_cache_hits",
    "peer_cache_evictions",
    "source_returned_peers",
    "source_filtered_by_cache",
    "tcp_attempts",
    "utp_attempts",
    "tcp_connect_ok",
    "utp_connect_ok",
    "tcp_metadata_ok",
    "utp_metadata_ok",
]

# Labels of the failure breakdown and the counter behind each.
FAILURE_BREAKDOWN = [
    ("Source timeout", "source_timeout"),
    ("Source no peers", "source_no_peers"),
    ("Connect timeout", "fetch_connect_timeout"),
    ("Connect I/O", "fetch_connect_io"),
    ("Handshake", "fetch_handshake"),
    ("No extension", "fetch_no_extension"),
    ("Reject", "fetch_reject"),
    ("Bad piece", "fetch_bad_piece"),
    ("Transfer I/O", "fetch_io"),
    ("SHA1 mismatch", "sha1_mismatch"),
]

# List sorts, history intervals, page bounds, search threshold.
SORT_COLUMNS = {
    "verified_at": "verified_at",
    "size": "total_size",
    "files": "file_count",
    "name": "name",
}
INTERVALS = ["minute", "hour", "day"]
DEFAULT_PAGE_SIZE = 25
MAX_PAGE_SIZE = 100
SIMILARITY_THRESHOLD = 0.3
STALE_AFTER_SECONDS = 180

# Suffix of the system prompt on a second try.
RETRY_SUFFIX = (
    "\nYou must output exactly one XML block. No other text. "
    "Do not include markdown fences."
)
