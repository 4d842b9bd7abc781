"""Column functions over log text: names, states, masks, durations.

Everything here is a built-in expression, so it stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Machine states in id order, 0 to 18.  Lookup by containment
# goes through them in this order and takes the first that fits.
STATE_NAMES = (
    "UNDEFINED", "INIT", "POWER_DISABLE", "OFF", "SERVICE", "MECH_INIT",
    "STANDBY", "GET_READY", "READY", "PRE_PRINT", "PRINT", "POST_PRINT",
    "PAUSE", "RECOVERY", "GO_TO_OFF", "GO_TO_STANDBY", "GO_TO_SERVICE",
    "SML_OFF", "DYNAMIC_READY",
)

# Short status codes of an input/output channel and their words.
IO_STATUS_WORDS = {
    "Inv": "InvalidHW",
    "NM": "NotMonitored",
    "NA": "NotActive",
    "Op": "Operational",
    "OpL": "OperationalLow",
    "OpH": "OperationalHigh",
    "PnL": "PanicLow",
    "PnH": "PanicHigh",
}

# Fixed value: what counts as changing content when two messages are compared.
DEFAULT_MASK = r"\d{2}:\d{2}:\d{2}(\.\d+)?|\d+"

# Time formats tried when a text is neither ISO nor a number.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "HH:mm:ss.SSS",
    "HH:mm:ss",
)

# Word groups that classify a signal by its name, in order.
SIGNAL_KEYWORDS = {
    "Axis / Motion": ("axis", "motion", "position", "velocity", "speed"),
    "IO / Sensors": ("io", "sensor", "input", "output", "digital"),
    "States / Logic": ("state", "status", "mode", "flag", "enable"),
    "Temperature": ("temp", "temperature", "heat"),
    "Pressure": ("pressure", "vacuum", "bar"),
    "Events": ("event",),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """True for null or empty text."""
    c = _col(c)
    return c.isNull() | (c == F.lit(""))


def contains_ci(c: Column | str, text: str) -> Column:
    """Ignore-case contains; false for null."""
    return F.coalesce(F.contains(F.lower(_col(c)), F.lit(text.lower())), F.lit(False))


def starts_ci(c: Column | str, text: str) -> Column:
    return F.coalesce(F.startswith(F.lower(_col(c)), F.lit(text.lower())), F.lit(False))


def equals_ci(c: Column | str, text: str) -> Column:
    return F.coalesce(F.lower(_col(c)) == F.lit(text.lower()), F.lit(False))


def short_logger(c: Column | str) -> Column:
    """Last two dotted parts of a logger; null or empty gives ``Unknown``."""
    c = _col(c)
    return F.when(blank(c), F.lit("Unknown")).otherwise(F.substring_index(c, ".", -2))


def truncate_text(c: Column | str, n: int) -> Column:
    """First ``n`` characters and ``...`` when longer; empty gives ``(empty)``."""
    c = _col(c)
    return (
        F.when(blank(c), F.lit("(empty)"))
        .when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("...")))
        .otherwise(c)
    )


def is_transition(message: Column | str = "message", thread: Column | str = "thread") -> Column:
    """Record that moves the machine to another state (ignore case)."""
    message = _col(message)
    return (
        equals_ci(thread, "Manager")
        & starts_ci(message, "PlcMngr:")
        & F.coalesce(F.contains(message, F.lit("->")), F.lit(False))
    )


def is_failure(message: Column | str = "message", thread: Column | str = "thread") -> Column:
    """Record that reports a machine failure event."""
    return equals_ci(thread, "Events") & F.coalesce(
        F.contains(_col(message), F.lit("PLC_FAILURE_STATE_CHANGE")), F.lit(False)
    )


def from_state(message: Column | str = "message") -> Column:
    """State before the first arrow of a transition text."""
    left = F.split_part(_col(message), F.lit("->"), F.lit(1))
    return F.trim(F.replace(left, F.lit("PlcMngr:"), F.lit("")))


def to_state(message: Column | str = "message") -> Column:
    """State after the first arrow; a second arrow ends it."""
    return F.trim(F.split_part(_col(message), F.lit("->"), F.lit(2)))


def transition_title(message: Column | str = "message") -> Column:
    return F.concat(from_state(message), F.lit(" -> "), to_state(message))


def state_id(c: Column | str) -> Column:
    """Numeric id of a state text: number, exact name, contained name, else 0."""
    c = _col(c)
    clean = F.upper(F.trim(c))
    number = F.when(F.trim(c).rlike(r"^[+-]?\d{1,10}$"), F.trim(c).try_cast("int"))
    exact = F.lit(None).cast("int")
    inside = F.lit(None).cast("int")
    for ident, name in reversed(list(enumerate(STATE_NAMES))):
        exact = F.when(clean == name, F.lit(ident)).otherwise(exact)
        inside = F.when(F.contains(clean, F.lit(name)), F.lit(ident)).otherwise(inside)
    return F.coalesce(number, exact, inside, F.lit(0))


def state_name(c: Column | str) -> Column:
    """Name of a state id; an unknown id is shown as its number."""
    c = _col(c)
    names = F.array(*[F.lit(n) for n in STATE_NAMES])
    return F.when(c.between(0, len(STATE_NAMES) - 1), F.get(names, c.cast("int"))).otherwise(c.cast("string"))


def io_status(c: Column | str) -> Column:
    """Words for a channel status code; empty gives ``Op``, unknown is trimmed."""
    c = _col(c)
    key = F.trim(c)
    words = F.create_map(*[F.lit(x) for pair in IO_STATUS_WORDS.items() for x in pair])
    return F.when(blank(c), F.lit("Op")).otherwise(F.coalesce(F.try_element_at(words, key), key))


def mask_text(c: Column | str, pattern: str | None = DEFAULT_MASK) -> Column:
    """Replace changing content by ``#``; an unusable pattern masks nothing."""
    from logloom.functions.conditions import regex_usable

    c = F.coalesce(_col(c), F.lit(""))
    if not pattern or not regex_usable(pattern):
        return c
    return F.regexp_replace(c, F.lit(f"(?i){pattern}"), F.lit("#"))


def parse_time(c: Column | str, base_date: str | None = None) -> Column:
    """Time from ISO text, epoch number, seconds of ``base_date`` or known formats.

    Numbers above 1e12 are milliseconds, above 1e9 seconds; smaller ones count
    seconds from ``base_date`` and are null when none is given.
    """
    c = F.trim(_col(c))
    number = c.try_cast("double")
    number = F.when(F.abs(number) < 1e15, number)  # neither NaN nor beyond any time
    base = F.lit(base_date).cast("timestamp") if base_date else F.lit(None).cast("timestamp")
    seconds = F.timestamp_micros((number * 1_000_000).cast("bigint") + F.unix_micros(base))
    numeric = (
        F.when(number > 1e12, F.timestamp_millis(number.cast("bigint")))
        .when(number > 1e9, F.timestamp_micros((number * 1_000_000).cast("bigint")))
        .otherwise(seconds)
    )
    timed = []
    for fmt in TIME_FORMATS:
        if fmt.startswith("HH"):
            if base_date:
                timed.append(F.try_to_timestamp(F.concat(F.lit(f"{base_date} "), c), F.lit(f"yyyy-MM-dd {fmt}")))
        else:
            timed.append(F.try_to_timestamp(c, F.lit(fmt)))
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c.try_cast("timestamp"))
    return F.when(number.isNotNull(), numeric).otherwise(F.coalesce(iso, *timed))


def signal_category(c: Column | str) -> Column:
    """Category of a wide column by its name: IO, Axis or All."""
    name = F.lower(_col(c))
    axis = name.rlike("-setp|-actp|-setv|-actv|-trq|-lagerr")
    io = F.contains(name, F.lit("[ios-")) | F.contains(name, F.lit("[io_mon"))
    io_param = name.rlike("-value|-mottemp|-drvtemp")
    return F.when(io, "IO").when(axis, "Axis").when(io_param, "IO").otherwise("All")


def in_signal_group(c: Column | str, group: str) -> Column:
    """True when a signal name holds one of the group's key words."""
    name = F.lower(_col(c))
    return F.coalesce(name.rlike("|".join(SIGNAL_KEYWORDS[group])), F.lit(False))


def duration_text(seconds: Column | str) -> Column:
    """``x.x min`` from one minute on, else ``x.x sec``."""
    s = _col(seconds)
    return F.when(s >= 60, F.format_string("%.1f min", s / 60)).otherwise(F.format_string("%.1f sec", s))


def delta_text(millis: Column | str) -> Column:
    """Signed time difference: ``0ms``, ``+12ms`` or ``-1.2s``."""
    ms = _col(millis).cast("double")
    plus = F.when(ms > 0, F.lit("+")).otherwise(F.lit(""))
    small = F.concat(plus, F.format_string("%.0fms", ms))
    large = F.concat(plus, F.format_string("%.1fs", ms / 1000))
    return F.when(F.abs(ms) < 1, "0ms").when(F.abs(ms) < 1000, small).otherwise(large)


def delta_class(millis: Column | str) -> Column:
    """How well two records are aligned: below 0.1 s, below 1 s, or further apart."""
    size = F.abs(_col(millis))
    return F.when(size < 100, "sync").when(size < 1000, "near").otherwise("far")
