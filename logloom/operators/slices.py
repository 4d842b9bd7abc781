"""Slice records out of nested JSON that stands inside a log message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.text import contains_ci

MARK = "stripeDescriptor"

# Fields of the three levels of a record: (JSON name, our name).
STRIPE_INTS = {
    "parentSpreadId": "spread_id", "stripeId": "stripe_id", "reportId": "report_id", "nSliceGroups": "n_slice_groups",
    "blanketLoopRepeatLenUm": "blanket_repeat_um", "blanketLoopT2TotalLenUm": "blanket_t2_total_um",
    "startPosInBlanketLoopUm": "start_in_blanket_um",
}
STRIPE_DOUBLES = {
    "stripeLenUm": "len_um", "stripeLenNotScaledUm": "len_not_scaled_um", "webRepeatLenScalingFactor": "web_repeat_scaling",
}
STRIPE_BOOLS = {
    "nullStripe": "is_null", "lastStripeInSpread": "last_in_spread", "imageToBru": "image_to_bru",
    "reportPrintDetails": "report_print_details", "firstInBlanketLoop": "first_in_blanket", "lastInBlanketLoop": "last_in_blanket",
}
STRIPE_STRINGS = {"dataTransferControl": "data_transfer_control"}
SPM_INTS = {"MeasureId": "spm_measure_id", "NumOfStrips": "spm_num_of_strips"}
SPM_STRINGS = {"ScanDirection": "spm_scan_direction", "MeasureMode": "spm_measure_mode"}
ILS_INTS = {"ScanLenUm": "ils_scan_len_um", "ScanSpeedUmSec": "ils_scan_speed_um_sec"}
SLICE_INTS = {
    "sliceId": "slice_id", "sliceStamp": "slice_stamp", "parentSeparationId": "parent_separation_id", "inkId": "ink_id",
    "startPosUm": "start_um", "endPosUm": "end_um",
}
SLICE_NESTED_INTS = {
    "bidData": {"vDeveloper": "v_developer", "vElectrode": "v_electrode", "vSqueegee": "v_squeegee", "vCleaner": "v_cleaner"},
    "crData": {"vDc": "cr_v_dc", "vAc": "cr_v_ac"},
    "asidData": {"VAsid": "v_asid"},
    "lphData": {"nScanLines": "n_scan_lines"},
    "emData": {"measureId": "em_measure_id"},
}

INT_LIMIT = 2**31
WHOLE_LIMIT = 1e15  # below it a double holds all digits of a whole number and its thousandths
# A named part whose value is no object.
_NOT_OBJECT = r'"({})({})"\s*:\s*(?!\{{)\S'


def balanced_object(text: Column) -> Column:
    """The first ``{...}`` with balanced braces, null when there is none.

    The pieces before closing braces are folded to one number, however long the
    text is: the open braces in its upper half, the pieces read in its lower.
    """
    one_open = 2**32

    def step(state: Column, piece: Column) -> Column:
        opened = F.octet_length(piece) - F.octet_length(F.replace(piece, F.lit("{"), F.lit("")))
        return F.when((state > 0) & (state < one_open), state).otherwise(state + (opened - 1) * F.lit(one_open) + 1)

    def closes(pieces: Column) -> Column:
        closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # no brace ends the last
        return F.aggregate(closed, F.lit(0).cast("bigint"), step, lambda s: F.when(s < one_open, s).otherwise(F.lit(0)).cast("int"))

    def cut(tail: Column) -> Column:
        ends = F.transform(F.array(F.split(tail, "}")), closes)
        whole = F.transform(ends, lambda n: F.when(n > 0, F.concat(F.call_function("substring_index", tail, F.lit("}"), n), F.lit("}"))))
        return F.get(whole, F.lit(0))

    # As elements of one-element arrays the text from the first brace on, its
    # pieces and the scan's result are made once for all their uses.
    found = F.transform(F.array(F.substr(text, F.instr(text, F.lit("{")))), cut)
    return F.when(F.contains(text, F.lit("{")), F.get(found, F.lit(0)))


def _fields(ints: Sequence[str] = (), doubles: Sequence[str] = (), bools: Sequence[str] = (), strings: Sequence[str] = (), more: Sequence[str] = ()) -> str:
    """Schema of typed fields; a value of the wrong JSON kind reads as null.

    Integers are read as doubles, so that a number with a fraction shows.
    """
    fields = [f"`{n}`: double" for n in (*ints, *doubles)] + [f"`{n}`: boolean" for n in bools] + [f"`{n}`: string" for n in strings]
    return ", ".join([*fields, *more])


def _is_object(raw: Column) -> Column:
    return F.startswith(F.ltrim(raw), F.lit("{"))


def _int(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0)).cast("int")


def _bad_int(value: Column) -> Column:
    """A number that is no 32-bit integer."""
    return F.coalesce((value != F.floor(value)) | (F.abs(value) >= INT_LIMIT), F.lit(False))


def _any_bad(struct: Column, names: Sequence[str]) -> Column:
    bad = F.lit(False)
    for n in names:
        bad |= _bad_int(struct[n])
    return bad


def explode_slices(logs: DataFrame, by: Sequence[str] = ("session",), message: str = "message", data: str | None = "data") -> DataFrame:
    """One row per slice of every record that describes a stripe.

    The object is the first balanced ``{...}`` of data, else of the message.
    Groups and slices are members named ``#...`` in document order; a group
    without slices takes no number.  A field of the wrong JSON kind is 0, false
    or null.  A number that is no integer drops its slice (the slice keeps its
    number) or, above the slices, the record.  A record without slices gives
    one row with both indexes -1.
    """
    texts = [c for c in (data, message) if c and c in logs.columns]
    keep = [c for c in (*by, "ts", "seq") if c in logs.columns]
    test = F.lit(False)
    for c in texts:
        test |= F.coalesce(F.contains(c, F.lit(MARK)), F.lit(False))
    # One pass over the text reads all levels down to the numbered groups.
    stripe_type = _fields(STRIPE_INTS, STRIPE_DOUBLES, STRIPE_BOOLS, STRIPE_STRINGS, ["sliceGroups: map<string,string>"])
    spm_type = _fields(SPM_INTS, (), ("IsActive",), SPM_STRINGS)
    ils_type = _fields(ILS_INTS, (), ("IsActive",), ("ScanMode",))
    whole = (
        f"{MARK}: struct<{stripe_type}>, SpmMeasureInstruction: struct<{spm_type}>, IlsMeasureInstruction: struct<{ils_type}>"
    )

    def usable(c: str) -> Column:
        # Filtering a one-element array reads the object once for all its uses.
        found = F.array(F.when(F.contains(c, F.lit(MARK)), balanced_object(F.col(c))))
        odd = lambda o: F.contains(o, F.lit("MeasureInstruction")) & o.rlike(_NOT_OBJECT.format("Spm|Ils", "MeasureInstruction"))
        read = F.transform(found, lambda o: F.when(~odd(o), F.from_json(o, f"struct<{whole}>")))
        return F.get(F.filter(read, lambda r: r[MARK].isNotNull()), F.lit(0))

    # Reading an object costs far more than moving its text, so marked records,
    # which may stand in a few files, are dealt out before.  As an explode of one
    # element the upper level is read once, whatever is filtered by it later.
    marked = logs.where(test).repartition(*[F.col(c) for c in keep if c in ("ts", "seq")] or [F.xxhash64(*texts)])
    rows = marked.select(*keep, F.explode(F.array(F.coalesce(*[usable(c) for c in texts]))).alias("_top")).select(
        *keep, F.col(f"_top.{MARK}").alias("_stripe"), F.col("_top.SpmMeasureInstruction").alias("_spm"),
        F.col("_top.IlsMeasureInstruction").alias("_ils"),
    )
    spm_on = F.coalesce(F.col("_spm.IsActive"), F.lit(False))
    bad = _any_bad(F.col("_stripe"), list(STRIPE_INTS)) | _any_bad(F.col("_ils"), list(ILS_INTS))
    bad |= spm_on & _any_bad(F.col("_spm"), list(SPM_INTS))
    stripe, spm, ils = F.col("_stripe"), F.col("_spm"), F.col("_ils")
    flat = {our: _int(stripe[n]) for n, our in STRIPE_INTS.items()}
    flat |= {our: F.coalesce(stripe[n], F.lit(0.0)) for n, our in STRIPE_DOUBLES.items()}
    flat |= {our: F.coalesce(stripe[n], F.lit(False)) for n, our in STRIPE_BOOLS.items()}
    flat |= {our: stripe[n] for n, our in STRIPE_STRINGS.items()}
    flat["spm_status"] = F.when(spm_on, "Active").otherwise("None")
    flat |= {our: F.when(spm_on, _int(spm[n])).otherwise(F.lit(0)) for n, our in SPM_INTS.items()}
    flat |= {our: F.when(spm_on, spm[n]) for n, our in SPM_STRINGS.items()}
    flat["ils_is_active"] = F.coalesce(ils["IsActive"], F.lit(False))
    flat |= {our: _int(ils[n]) for n, our in ILS_INTS.items()}
    flat["ils_scan_mode"] = ils["ScanMode"]
    flat = {n: c.alias(n) for n, c in flat.items()}
    numbered = F.filter(F.map_entries("_stripe.sliceGroups"), lambda e: F.startswith(e["key"], F.lit("#")))
    with_slices = F.filter(
        F.transform(numbered, lambda e: F.from_json(e["value"], "slices map<string,string>")["slices"]), lambda s: s.isNotNull()
    )
    nested = [f"{n}: struct<{_fields(f, (), ('isActive',) if n == 'emData' else ())}>" for n, f in SLICE_NESTED_INTS.items()]
    slice_type = _fields(SLICE_INTS, (), ("stationIsActive",), ("hvTargetType",), nested)
    odd_part = _NOT_OBJECT.format("|".join(SLICE_NESTED_INTS), "")

    def read_slice(member: Column, group: Column, place: Column) -> Column:
        read = F.when(_is_object(member["value"]) & ~member["value"].rlike(odd_part), F.from_json(member["value"], f"struct<{slice_type}>"))
        return F.struct(group.alias("g"), place.alias("s"), read.alias("base"))

    def usable_slice(one: Column) -> Column:
        broken = one["base"].isNull() | _any_bad(one["base"], list(SLICE_INTS))
        for n, fields in SLICE_NESTED_INTS.items():
            broken |= _any_bad(one["base"][n], list(fields))
        return ~broken

    def of_group(slices: Column, group: Column) -> Column:
        members = F.filter(F.map_entries(slices), lambda e: F.startswith(e["key"], F.lit("#")))
        return F.transform(members, lambda e, i: read_slice(e, group, i))

    every = F.coalesce(F.flatten(F.transform(with_slices, of_group)), F.array())
    nothing = F.struct(F.lit(None).alias("g"), F.lit(None).alias("s"), F.lit(None).alias("base"))
    kept = F.transform(F.array(F.filter(every, usable_slice)), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(nothing)))
    usable_record = F.col("_stripe").isNotNull() & ~bad
    # A record's own columns are made once, before its slices are unfolded; all of
    # them after it would make a method that is too long for the JVM to compile.
    rows = rows.where(usable_record).select(*keep, *flat.values(), F.get(kept, F.lit(0)).alias("_slices"))
    rows = rows.select(*keep, *flat, F.inline_outer("_slices").alias("_group", "_place", "_base"))
    found, one = F.col("_base").isNotNull(), F.col("_base")
    out = {
        "group_index": F.coalesce("_group", F.lit(-1)),
        "slice_index": F.coalesce("_place", F.lit(-1)),
        **{our: _int(one[n]) for n, our in SLICE_INTS.items()},
        "station_active": F.when(found, F.coalesce(one["stationIsActive"], F.lit(False))).otherwise(F.lit(True)),
        "hv_target": F.when(found, F.coalesce(one["hvTargetType"], F.lit("Unknown"))),
        "em_is_active": F.coalesce(one["emData"]["isActive"], F.lit(False)),
    }
    for n, fields in SLICE_NESTED_INTS.items():
        out |= {our: _int(one[n][f]) for f, our in fields.items()}
    return rows.withColumns(out).drop("_group", "_place", "_base")


def slice_columns(df: DataFrame) -> DataFrame:
    """Derived columns: stripe type, millimetres, station status, voltage target flags."""

    def mm(um: str) -> Column:
        # Whole numbers, which most are, need no decimal arithmetic; "+ 0.0" takes the sign off a zero.
        n = F.col(um).cast("double")
        rounded = F.rint(n / 10.0) / 100.0 + 0.0
        if isinstance(df.schema[um].dataType, T.IntegerType):
            return rounded
        return F.when((n == F.floor(n)) & (F.abs(n) < WHOLE_LIMIT), rounded).otherwise(F.bround(n / 1000.0, 2))

    target = F.coalesce("hv_target", F.lit(""))
    return df.withColumns({
        "stripe_type": F.when(F.col("is_null"), "Null-Gap").otherwise("Print-Image"),
        "station_status": F.when(F.col("station_active"), "Active").otherwise("Inactive"),
        "len_mm": mm("len_um"),
        "len_not_scaled_mm": mm("len_not_scaled_um"),
        "start_mm": mm("start_um"),
        "end_mm": mm("end_um"),
        "start_in_blanket_mm": mm("start_in_blanket_um"),
        "blanket_repeat_mm": mm("blanket_repeat_um"),
        "ils_scan_len_mm": mm("ils_scan_len_um"),
        "is_vjos_target": target == "HV_TO_VJOS",
        "is_print_target": target == "HV_TO_PRINT",
        "is_null_target": target == "HV_TO_NULL",
        "hv_mismatch": F.col("is_null") & (target != "HV_TO_NULL"),
    })


# Columns that a slice search over all columns looks at.
SEARCH_COLUMNS = (
    "hv_target", "spm_status", "stripe_type", "ils_scan_mode", "data_transfer_control", "spm_scan_direction",
    "spm_measure_mode", "station_status", "spread_id", "stripe_id", "slice_index", "ink_id", "v_developer",
    "v_electrode", "v_squeegee", "v_cleaner", "cr_v_dc", "cr_v_ac", "v_asid", "n_scan_lines",
)


def slice_test(
    active_only: bool = False,
    stripe_type: str | None = None,
    ink: int | None = None,
    text: str | None = None,
    column: str = "all",
) -> Column:
    """Whether a slice passes station, type and ink, and has a text in one or all columns."""
    keep = F.lit(True)
    if active_only:
        keep &= F.col("station_active")
    if stripe_type:
        keep &= F.col("stripe_type") == stripe_type
    if ink is not None:
        keep &= F.col("ink_id") == ink
    if text and text.strip():
        names = SEARCH_COLUMNS if column == "all" else (column,)
        found = F.lit(False)
        for n in names:
            found |= contains_ci(F.col(n).cast("string"), text.strip())
        keep &= found
    return keep


def slice_filter(
    df: DataFrame,
    active_only: bool = False,
    stripe_type: str | None = None,
    ink: int | None = None,
    text: str | None = None,
    column: str = "all",
) -> DataFrame:
    """Slices by station, type and ink, and by a text in one or all columns."""
    return df.where(slice_test(active_only, stripe_type, ink, text, column))


def slice_filters(df: DataFrame, tests: dict[str, dict], name: str = "kind") -> DataFrame:
    """Several :func:`slice_filter` of the same slices, which are read once: a row for each filter it passes, named in ``name``."""
    passed = [F.when(slice_test(**test), F.lit(kind)) for kind, test in tests.items()]
    return df.select("*", F.explode(F.array_compact(F.array(*passed))).alias(name))


def spread_range(df: DataFrame, lo: int | None = None, hi: int | None = None, equals: int | None = None) -> DataFrame:
    """Slices of one spread, or of an open-ended range of spreads."""
    keep = F.lit(True)
    if equals is not None:
        return df.where(F.col("spread_id") == equals)
    if lo is not None:
        keep &= F.col("spread_id") >= lo
    if hi is not None:
        keep &= F.col("spread_id") <= hi
    return df.where(keep)


def slice_stats(df: DataFrame) -> DataFrame:
    """Rows, print and null rows, and the length of all stripes in metres.

    A stripe's length is that of its first row; of rows of one place the shortest counts.
    """
    first = F.struct("ts", *(["seq"] if "seq" in df.columns else []), "group_index", "slice_index", "len_mm")
    per_stripe = df.groupBy("spread_id", "stripe_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("stripe_type") == "Print-Image").alias("p"),
        F.count_if(F.col("stripe_type") == "Null-Gap").alias("z"),
        F.min_by("len_mm", first).alias("len_mm"),
    )
    return per_stripe.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_print"),
        F.coalesce(F.sum("z"), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum("len_mm") / 1000, F.lit(0.0)).alias("total_m"),
    )
