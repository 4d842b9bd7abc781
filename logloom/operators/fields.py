"""Fields taken out of a record's message, and tags given to a record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.conditions import FIELD_COLUMNS, cond
from logloom.functions.text import blank, contains_ci, equals_ci, is_transition, starts_ci

# Patterns of the fields written into a message.
PATTERN_FIELD = r"(?i)Pattern[:=]\s*([^\s,;]+)"
DATA_FIELD = r"(?i)Data[:=]\s*(\{[^}]*\}|[^\s,;]+)"
EXCEPTION_FIELD = r"(?is)(?:Exception|Error)[:=]\s*(.+?)(?=\s*(?:at |$))"
EXCEPTION_CLASS = r"(?s)\b(\w+Exception:.*)"

# Records of the application log that get a tag of their own.
CANCELLATION_LOGGER = "Press.BL.Printing.Pipeline.PipelineCancellationProvider"
STATE_MANAGER_LOGGER = "PressStateManager"
FALL_METHOD = "FallToPressStateAsync"


def _first_group(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, null when there is none."""
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))


def _existing(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def parse_fields(df: DataFrame, message: str = "message", level: str = "level") -> DataFrame:
    """Pattern, data and exception found in the message.

    A field already set stays when the message does not name it.  A cheap text
    test stands before each expression, so most records never reach the regex.
    """
    msg = F.col(message)
    has_pattern = contains_ci(msg, "Pattern")
    has_data = contains_ci(msg, "Data") | F.coalesce(F.contains(msg, F.lit("{")), F.lit(False))
    has_error = contains_ci(msg, "Exception") | contains_ci(msg, "Error:")
    named_class = _first_group(msg, EXCEPTION_CLASS)
    exception = F.when(
        has_error, F.coalesce(_first_group(msg, EXCEPTION_FIELD), named_class)
    )
    exception = F.coalesce(exception, _existing(df, "exception"))
    reads_as_error = contains_ci(msg, "failed") | contains_ci(msg, "error") | contains_ci(msg, "exception")
    fallback = blank(exception) & equals_ci(level, "Error") & reads_as_error
    return df.withColumns({
        "pattern": F.coalesce(F.when(has_pattern, _first_group(msg, PATTERN_FIELD)), _existing(df, "pattern")),
        "data": F.coalesce(F.when(has_data, _first_group(msg, DATA_FIELD)), _existing(df, "data")),
        "exception": F.when(fallback, msg).otherwise(exception),
    })


def tag_records(df: DataFrame) -> DataFrame:
    """Mark state transitions and failure events; a missing level is ``Info``."""
    transition = (
        (F.col("thread") == "Manager") & starts_ci("message", "PlcMngr:") & F.contains("message", F.lit("->"))
    )
    failure = (F.col("thread") == "Events") & F.contains("message", F.lit("PLC_FAILURE_STATE_CHANGE"))
    return df.withColumns({
        "level": F.coalesce("level", F.lit("Info")),
        "is_transition": F.coalesce(transition, F.lit(False)),
        "is_failure": F.coalesce(failure, F.lit(False)),
    })


def tag_default(df: DataFrame, source: str = "source") -> DataFrame:
    """Factory tag of a record, first rule that fits wins; null when none does."""
    app = F.col(source) == "APP"
    error = equals_ci("level", "Error")

    def has(column: str, text: str) -> Column:
        return F.coalesce(F.contains(column, F.lit(text)), F.lit(False))

    tag = (
        F.when(app & error & has("logger", CANCELLATION_LOGGER), "cancellation")
        .when(app & has("logger", STATE_MANAGER_LOGGER) & has("method", FALL_METHOD), "fall_to_state")
        .when(error, "error")
        .when(~app & equals_ci("thread", "Events"), "event")
        .when(~app & is_transition(), "transition")
    )
    return df.withColumn("tag", tag)


def _rule(rule: dict) -> Column:
    # Here an unknown field or operator never fits, and an empty text never does.
    known = rule.get("field", "").lower() in {f.lower() for f in FIELD_COLUMNS}
    ops = {"contains": "Contains", "equals": "Equals", "begins with": "Begins With", "ends with": "Ends With", "regex": "Regex"}
    op = ops.get((rule.get("op") or "").lower())
    if not known or op is None or (op in ("Contains", "Regex") and not rule.get("value")):
        return F.lit(False)
    field = next(f for f in FIELD_COLUMNS if f.lower() == rule["field"].lower())
    return cond(field, op, rule.get("value"))


def tag_rules(df: DataFrame, rules: Sequence[dict], name: str = "tag") -> DataFrame:
    """Tag of the first of a list of rules ``{field, op, value, tag}`` that fits."""
    tag = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        tag = F.when(_rule(rule), F.lit(rule["tag"])).otherwise(tag)
    return df.withColumn(name, tag)


def tick_class(df: DataFrame) -> DataFrame:
    """Class of a record in the overview strip: Error, StateTransition or None."""
    error = equals_ci("level", "Error") | equals_ci("thread", "Events")
    return df.withColumn("tick", F.when(error, "Error").when(is_transition(), "StateTransition").otherwise("None"))


def record_state(df: DataFrame) -> DataFrame:
    """State a record names: its pattern, else a ``...State=`` pair of its data."""
    pattern, data = F.col("pattern"), F.col("data")
    parts = F.filter(F.split(data, "[=,;]"), lambda p: p != "")
    spots = F.sequence(F.lit(1), F.size(parts) - 1)
    named = F.filter(spots, lambda i: F.endswith(F.lower(F.trim(F.element_at(parts, i))), F.lit("state")))
    value = F.when(
        F.contains(data, F.lit("State")) & (F.size(parts) > 1) & (F.size(named) > 0),
        F.trim(F.get(parts, F.get(named, F.lit(0)))),
    )
    state = F.when(F.contains(pattern, F.lit("STATE")), pattern)
    return df.withColumn("state_named", F.coalesce(state, value, F.lit("Unknown")))
