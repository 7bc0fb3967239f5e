"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is a FIXED VALUE (lookup tables, thresholds,
palette, formats). They are stated plainly, in their natural order, so that
results match; the logic that uses them lives elsewhere.
"""

from __future__ import annotations

# --- FIXED VALUES: column-role aliases (matched after strip + lower) --------
ALIASES: dict[str, tuple[str, ...]] = {
    "user_id": (
        "user_id", "userid", "uid", "user", "u", "customer_id", "customerid",
        "actor_id", "actorid", "distinct_id", "distinctid", "anonymous_id",
        "anonymousid", "person_id", "personid",
    ),
    "timestamp": (
        "timestamp", "ts", "time", "datetime", "event_time", "eventtime",
        "occurred_at", "occurredat", "created_at", "createdat", "happened_at",
        "happenedat", "_time",
    ),
    "event_name": (
        "event_name", "eventname", "event", "name", "action", "type",
        "event_type", "eventtype", "track", "trackname",
    ),
    "session_id": (
        "session_id", "sessionid", "sid", "session", "sess_id", "sessid",
    ),
}

# --- FIXED VALUES: content-sniff thresholds --------------------------------
SNIFF_THRESHOLDS = (("timestamp", 0.8), ("user_id", 0.5), ("event_name", 0.5))
ISO_TIMESTAMP_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
)
EPOCH_SECONDS_RANGE = (1_000_000_000, 4_000_000_000)
EPOCH_MILLIS_RANGE = (1_000_000_000_000, 4_000_000_000_000)
EPOCH_MILLIS_ABOVE = 1e12  # integer epoch column: max above this -> ms, else s

# --- FIXED VALUES: event-name tokenizer and verb-suffix families -----------
TOKEN_SEPARATORS = r"_.\-: "
VERB_FAMILIES: dict[str, str] = {
    "viewed": "view", "opened": "view", "shown": "view", "displayed": "view",
    "rendered": "view", "impression": "view",
    "clicked": "click", "tapped": "click", "selected": "click",
    "pressed": "click", "chose": "click",
    "submitted": "submit", "sent": "submit", "posted": "submit",
    "created": "submit", "completed": "submit",
    "closed": "close", "dismissed": "close", "cancelled": "close",
    "canceled": "close", "abandoned": "close",
    "failed": "error", "error": "error", "exception": "error", "denied": "error",
    "started": "start", "began": "start", "init": "start",
    "succeeded": "success", "ok": "success", "success": "success",
    "received": "success", "loaded": "success", "fetched": "success",
    "resolved": "success",
    "copied": "click", "toggled": "click", "dragged": "click",
    "scrolled": "click", "searched": "click", "filtered": "click",
    "sorted": "click",
    "edited": "submit", "updated": "submit", "saved": "submit",
    "uploaded": "submit", "used": "submit", "invoked": "submit",
    "triggered": "submit", "executed": "submit", "generated": "submit",
    "requested": "submit",
    "downloaded": "click",
    "exported": "submit", "imported": "submit",
    "archived": "close", "deleted": "close", "removed": "close",
    "revoked": "close",
}
MAX_FAMILIES = 12
PREFIX_MIN_DISTINCT = 3
PREFIX_MIN_SHARE = 0.005
OTHER_FAMILY = "other"

# --- FIXED VALUES: 12-slot palette (color, bg, fg) and the "other" colours --
PALETTE: tuple[tuple[str, str, str], ...] = (
    ("#3B82F6", "#DBEAFE", "#1E40AF"),
    ("#10B981", "#D1FAE5", "#065F46"),
    ("#F59E0B", "#FEF3C7", "#92400E"),
    ("#EF4444", "#FEE2E2", "#991B1B"),
    ("#8B5CF6", "#EDE9FE", "#5B21B6"),
    ("#EC4899", "#FCE7F3", "#9D174D"),
    ("#06B6D4", "#CFFAFE", "#164E63"),
    ("#F97316", "#FFEDD5", "#9A3412"),
    ("#84CC16", "#ECFCCB", "#3F6212"),
    ("#6366F1", "#E0E7FF", "#3730A3"),
    ("#14B8A6", "#CCFBF1", "#134E4A"),
    ("#A855F7", "#F3E8FF", "#6B21A8"),
)
OTHER_COLORS = ("#9CA3AF", "#F3F4F6", "#374151")

# --- FIXED VALUES: column classification ------------------------------------
USER_ATTR_PREFIX_PATTERN = r"(?i)^(user_|u_)"
FREE_TEXT_SHARE = 0.8
MAX_ATTR_CARDINALITY = 50

# --- FIXED VALUES: insights -------------------------------------------------
STUCK_DEFAULT_MIN_RUN = 3
STUCK_HIGH_MIN_RUN = 5
STUCK_HIGH_EVENTS = ("message_sent", "response_received")
STUCK_TOP_N = 10
TOP_FAMILIES_N = 3

# --- FIXED VALUES: defaults of the public surface ---------------------------
DEFAULT_SESSION_GAP_MINUTES = 30
DEFAULT_TOP_EVENTS = 50
REDACTED = "<redacted>"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
HHMM_FORMAT = "HH:mm"
MINUTE_FORMAT = "yyyy-MM-dd HH:mm"
