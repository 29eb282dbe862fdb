"""Limits, thresholds, labels and templates that results depend on."""

# --- search answers -------------------------------------------------------
# One entry per kind of search.
KINDS = {
    "academic": {"category": "science", "title": "Academic", "noun": "academic", "link": "Source"},
    "news": {"category": "news", "title": "News", "noun": "news", "link": "Source"},
    "video": {"category": "videos", "title": "Video", "noun": "video", "link": "Link"},
}
LANGUAGE = "en"
RESULTS_PER_ANSWER = 6
NO_TITLE = "No title"
DAMAGED = "the answer is no JSON object"
SEPARATOR = " — "

# --- chat clean-up --------------------------------------------------------
# Opening and closing forms may differ, shortest match, any case.
THINKING = r"(?is)<think(?:ing)?>.*?</think(?:ing)?>"
# Every character Python's str.strip removes.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- units ----------------------------------------------------------------
BYTE_STEP = 1024
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")
PAGE_BYTES = 16384
USED_COUNTERS = ("Pages active", "Pages wired down", "Pages speculative")

# --- health ---------------------------------------------------------------
PROBE_TIMEOUT_MS = 3000
POLL_SECONDS = 10
STALE_SECONDS = 5
LATENCY_BANDS = ((100, "go"), (300, "warn"))
SLOW_BAND = "stop"
RETRIES = 3
READY_TRIES = 20
IDLE_SECONDS = 300
CARD_STAGGER_MS = 70
ACCENTS = {"Checking": "#2e2e2e", "Online": "#00e87a", "Offline": "#ff3b5c"}

# --- models ---------------------------------------------------------------
MODEL_PREFIX = "mlx-community/"
