"""Wide time-series tables: one row per time, one column per signal."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.operators.filters import where_in
from logloom.operators.single import join_on
from logloom.operators.states import machine_state_intervals, step_intervals
from logloom.operators.telemetry import (
    AXIS_PARAMS,
    LOGSTAT_PATTERNS,
    LOGSTAT_WARN,
    PREFIXES,
    begins,
    parse_event_text,
    parse_steps_chart,
    signal_runs,
    signals_said,
)
from logloom.operators.telemetry import machine_state as state_of
from logloom.operators.timeslice import SLICE, Grouping, Splits, epoch_micros, find_splits, time_axis

# Order of the four kinds in the column list.
KIND_ORDER = {"Axis": 0, "Step": 1, "IO": 2, "LogStats": 3}
CELLS = 1 << 20  # cells that are filled at once
STATE, EVENTS = "\u0001state", "\u0001events"


def _selected(rows: DataFrame, wanted: Sequence[str] | None, *names: str) -> DataFrame:
    """Rows of the wanted ``subsystem|component`` names, ignoring case."""
    if wanted is None:
        return rows
    keyed = rows.withColumn("_sel", F.concat_ws("|", *names))
    return where_in(keyed, "_sel", wanted).drop("_sel")


def _signals(io: Sequence[str] | None, axis: Sequence[str] | None, steps: Sequence[str] | None, logstats: bool) -> Column:
    """The chosen signals of a record, as an array."""
    kinds = [k for k in PREFIXES if logstats or k != "LogStats"]
    said = F.coalesce(signals_said(F.col("message"), F.col("thread"), kinds), F.array().cast(_SAID))

    def chosen(e: Column) -> Column:
        test = F.lit(True)
        for kind, wanted in (("IO", io), ("Axis", axis), ("Step", steps)):
            if wanted is not None:
                test &= (e["kind"] != kind) | F.lower(e["sel"]).isin([w.lower() for w in wanted])
        return test

    return F.filter(said, chosen)


_SAID = "array<struct<kind: string, sel: string, subsystem: string, component: string, param: string, pos: int, value: string>>"


def wide_long(
    logs: DataFrame, by: Sequence[str] = ("session",), io: Sequence[str] | None = None, axis: Sequence[str] | None = None,
    steps: Sequence[str] | None = None, logstats: bool = True,
) -> DataFrame:
    """The signal rows that fill a wide table, from one pass over the log.

    ``key`` is ``subsystem-component-param``; None selects everything, a list
    of ``subsystem|component`` (steps: ``parent|name``) selects those.
    """
    rows = logs.where(begins("message", *PREFIXES)).select(*by, "ts", "seq", "thread", F.inline(_signals(io, axis, steps, logstats)))
    return rows.withColumn("key", F.concat_ws("-", "subsystem", "component", "param")).drop("sel")


def signal_columns(
    logs: DataFrame, by: Sequence[str] = ("session",), io: Sequence[str] | None = None, axis: Sequence[str] | None = None,
    steps: Sequence[str] | None = None, logstats: bool = True,
) -> DataFrame:
    """``(kind, subsystem, component, param, key, name)`` of every column a wide table of the log can have.

    An axis or logging-health record names all its parameters, also those it
    holds no value for.  ``name`` ends in the thread that told the signal last.
    """
    rows = wide_long(logs, by, io, axis, steps, logstats)
    per_kind = F.when(F.col("kind") == "Axis", F.array(*[F.lit(p) for p in AXIS_PARAMS])).when(
        F.col("kind") == "LogStats", F.array(*[F.lit(p) for p in LOGSTAT_PATTERNS])
    ).otherwise(F.array("param"))
    last = F.max(F.struct(F.struct("ts", "seq").alias("place"), F.coalesce("thread", F.lit("Unknown")).alias("thread"))).alias("last")
    found = rows.groupBy("kind", "subsystem", "component", "param").agg(last).withColumn("param", F.explode(per_kind))
    found = found.groupBy("kind", "subsystem", "component", "param").agg(F.max("last").alias("last"))
    key = F.concat_ws("-", "subsystem", "component", "param")
    thread = F.col("last.thread")
    name = F.when(thread != "", F.concat(key, F.lit(" ["), thread, F.lit("]"))).otherwise(key)
    return found.select("kind", "subsystem", "component", "param", key.alias("key"), name.alias("name"))


def column_pairs(columns: DataFrame) -> list[tuple[str, str]]:
    """(key, name) of chosen rows of :func:`signal_columns`, in the order of a wide table."""
    rows = sorted(columns.collect(), key=lambda r: (KIND_ORDER[r.kind], r.subsystem.lower(), r.component.lower(), r.param.lower()))
    return [(r.key, r.name) for r in rows]


def _filled(single: DataFrame, by: Sequence[str], carried: int, columns: int, splits: Splits) -> DataFrame:
    """``(*by, ts, _c)``: per time an array of all columns, the first ``carried`` of them filled forward.

    ``single`` holds one row per time and column with a value.  Slices begin with
    one row of the last values before them; inside a slice rows run in order
    through numpy, ``CELLS`` cells at a time.
    """
    group = Grouping(single, by)
    sliced = group.prepare(single.withColumn(SLICE, splits.number(single, by, ("ts",))))
    cells = F.collect_list(F.struct("_i", "value"))
    times = sliced.groupBy(*group.keys, *group.extra, SLICE, "ts").agg(cells.alias("_cells"))
    # The last value of a column in a slice holds up to the slice with its next.
    each = times.select(*group.keys, SLICE, "ts", F.inline("_cells"))
    last = each.where(F.col("_i") < carried).groupBy(*group.keys, SLICE, "_i").agg(F.max_by("value", "ts").alias("value"))
    after = Window.partitionBy(*group.keys, "_i").orderBy(SLICE)
    # All three parts are made of the times, whose shuffle is so done once: here the cells are asked for, too.
    ends = times.groupBy(*group.keys).agg(F.max(SLICE).alias("_end"), F.max(F.size("_cells")).alias("_n")).where("_n > 0").drop("_n")
    spans = last.withColumn("_next", F.lead(SLICE).over(after)).join(ends, group.keys).withColumn("_to", F.coalesce("_next", "_end"))
    held = spans.where(F.col("_to") > F.col(SLICE)).select(*group.keys, F.explode(F.sequence(F.col(SLICE) + 1, F.col("_to"))).alias(SLICE), "_i", "value")
    begin = held.groupBy(*group.keys, SLICE).agg(cells.alias("_cells"))
    blank = {k: F.lit(None).cast(single.schema[k].dataType) for k in group.extra}
    begin = begin.withColumns({**blank, "ts": F.lit(None).cast(single.schema["ts"].dataType)})
    names = [*group.keys, *group.extra, SLICE, "ts", "_cells"]
    lines = times.select(*names, F.lit(1).alias("_rank")).unionByName(begin.select(*names, F.lit(0).alias("_rank")))
    dealt = lines.repartition(*group.keys, SLICE).sortWithinPartitions(*group.keys, SLICE, "_rank", "ts")
    n_keys, out_names, rows_at_once = len(group.keys), [*group.keys, *group.extra, "ts"], max(1, CELLS // max(columns, 1))

    def run(batches):
        now, state = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                b = whole.slice(at, rows_at_once)
                places = list(zip(*(b.column(k).to_pylist() for k in (*range(n_keys), b.schema.get_field_index(SLICE)))))
                lists = b.column(b.schema.get_field_index("_cells"))
                flat = lists.flatten()
                row = np.repeat(np.arange(len(places)), lists.value_lengths().to_numpy(zero_copy_only=False))
                values = np.full((len(places) + 1, columns), None, object)
                values[row + 1, flat.field(0).to_numpy()] = flat.field(1).to_numpy(zero_copy_only=False)
                known = np.zeros(values.shape, bool)
                known[row + 1, flat.field(0).to_numpy()] = True
                new = np.array([p != q for p, q in zip(places, [now, *places])], bool)
                known[1:][new, :carried] = True  # nothing comes over from another slice but its first row
                if state is not None:
                    values[0, :carried] = state
                known[0] = True
                source = np.maximum.accumulate(np.where(known[:, :carried], np.arange(len(values))[:, None], 0), axis=0)
                values[:, :carried] = values[source, np.arange(carried)]
                now, state = places[-1], values[-1, :carried].copy()
                shown = np.flatnonzero(b.column(b.schema.get_field_index("_rank")).to_numpy() == 1)
                cut = pa.array(np.arange(len(shown) + 1) * columns, pa.int32())
                array = pa.ListArray.from_arrays(cut, pa.array(values[1:][shown].ravel(), pa.string(), from_pandas=True))
                kept = b.take(pa.array(shown))
                yield pa.RecordBatch.from_arrays([*[kept.column(kept.schema.get_field_index(n)) for n in out_names], array], [*out_names, "_c"])

    schema = ", ".join([*[f"`{n}` {times.schema[n].dataType.simpleString()}" for n in out_names], "_c array<string>"])
    return group.restore(dealt.mapInArrow(run, schema))


def wide_series(
    logs: DataFrame,
    columns: Sequence[tuple[str, str]],
    io: Sequence[str] | None = None,
    axis: Sequence[str] | None = None,
    steps: Sequence[str] | None = None,
    threads: Sequence[str] = (),
    events: bool = False,
    machine_state: bool = True,
    unix_time: bool = False,
    logstats: bool = True,
    by: Sequence[str] = ("session",),
) -> DataFrame:
    """One row per time with every signal carried forward from its last value.

    ``columns`` names the signals as (key, column); :func:`signal_columns` lists
    all there are.  Messages of the chosen ``threads`` (and of events) stand only
    at their own time.  The log is read once; a record's signals, state and
    message are told apart by how it begins.
    """
    names = {t: f"{t}_Message" for t in sorted(threads)}
    message, thread = F.col("message"), F.col("thread")
    point = lambda key, value, pos: F.struct(key.alias("key"), value.alias("value"), pos.cast("int").alias("pos"))
    signals = F.transform(_signals(io, axis, steps, logstats), lambda e: point(F.concat_ws("-", e["subsystem"], e["component"], e["param"]), e["value"], e["pos"]))
    told = F.coalesce((message != "") & thread.isNotNull(), F.lit(False))
    own = []
    if machine_state:
        state = state_of(message)
        own.append(F.when(state.isNotNull(), point(F.lit(STATE), state, F.lit(0))))
    own += [F.when(told & (F.lower(thread) == t.lower()), point(F.lit(f"\u0001t:{t}"), message, F.lit(0))) for t in names]
    seen = told & (F.lower(thread) == "events")
    if not events:
        # Without a choice of events only messages that could hold telemetry make rows.
        seen &= F.lower(F.left("message", F.lit(1))).isin("a", "i", "c", "l") & F.lit(not (threads or io or axis or steps))
    own.append(F.when(seen, point(F.lit(EVENTS), message, F.lit(0))))
    wanted = begins(message, *PREFIXES) | F.lower(thread).isin(["events", *[t.lower() for t in names]])
    rows = logs.where(wanted).select(*by, "ts", "seq", F.inline(F.concat(signals, F.filter(F.array(*own), lambda p: p.isNotNull()))))
    # One value per (time, key) first; it is combined before the shuffle.
    single = rows.groupBy(*by, "ts", "key").agg(F.max_by("value", F.struct("seq", "pos")).alias("value"))
    keys = [k for k, _ in columns] + ([STATE] if machine_state else [])
    shown = keys + [f"\u0001t:{t}" for t in names] + ([EVENTS] if events else [])
    number = F.create_map(*[x for i, k in enumerate(shown) for x in (F.lit(k), F.lit(i))]) if shown else F.create_map().cast("map<string,int>")
    # Values of other keys only say that there is such a time: they go to one more column.
    placed = single.select(*by, "ts", F.coalesce(F.try_element_at(number, F.col("key")), F.lit(len(shown))).alias("_i"), "value")
    splits = find_splits(logs.where(wanted), by, ("ts",), max(1000, 16 * CELLS // (len(shown) + 1)))
    filled = _filled(placed, by, len(keys), len(shown) + 1, splits)
    out: list[Column] = [F.col("ts").alias("Time")]
    if unix_time:
        out.append(F.floor(epoch_micros(filled, "ts") / 1000).alias("Unix_Time"))
    cell = lambda i: F.get("_c", F.lit(i))
    if machine_state:
        out.append(F.coalesce(cell(len(columns)), F.lit("")).alias("Machine_State"))
    out += [cell(i).alias(name) for i, (_, name) in enumerate(columns)]
    if events:
        out.append(cell(len(keys) + len(names)).alias("Events_Message"))
    out += [cell(len(keys) + i).alias(label) for i, label in enumerate(names.values())]
    return filled.select(*by, *out)


def mark_warnings(wide: DataFrame) -> DataFrame:
    """Put ``[!] `` before logging-health values that should be zero."""
    cols = {}
    for name in wide.columns:
        bare = name.split(" [")[0]
        if bare.startswith("LogStats-Metrics-") and bare.rsplit("-", 1)[-1] in LOGSTAT_WARN:
            c = F.col(f"`{name}`")
            cols[name] = F.when(c != "0", F.concat(F.lit("[!] "), c)).otherwise(c)
    return wide.withColumns(cols) if cols else wide


def write_wide(wide: DataFrame, path: str, mode: str = "error") -> None:
    """Wide table as CSV with a header; cells with commas or quotes are quoted."""
    out = mark_warnings(wide).withColumn("Time", F.date_format("Time", "yyyy-MM-dd HH:mm:ss.SSS"))
    out.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def signal_package(
    logs: DataFrame,
    by: Sequence[str] = ("session",),
    io: Sequence[str] | None = None,
    axis: Sequence[str] | None = None,
    steps: Sequence[str] | None = None,
    threads: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Everything a chart session needs, as long tables on one index axis."""
    times = time_axis(logs, "ts", by)

    def on_axis(rows: DataFrame) -> DataFrame:
        return join_on(rows, times, ["ts", *by])

    wanted = None if io is None and axis is None else [*(io or ()), *(axis or ())]
    runs = signal_runs(logs, by, times)
    if wanted is not None:
        runs = where_in(runs.withColumn("_sel", F.regexp_replace(F.regexp_replace("signal", "-[^-]*$", ""), "-", "|")), "_sel", wanted).drop("_sel")
    step_rows = _selected(parse_steps_chart(logs, by), steps, "parent", "name")
    told = where_in(logs.where(F.col("thread") != ""), "thread", list(threads)) if threads else logs.where(F.lit(False))
    return {
        "axis": times,
        "signals": runs,
        "steps": step_intervals(on_axis(step_rows), [*by, "parent", "name"]),
        "machine_states": machine_state_intervals(logs, by),
        "messages": on_axis(told.select(*by, "ts", "thread", F.coalesce("message", F.lit("")).alias("message"))),
        "events": on_axis(parse_event_text(logs, by)),
    }
