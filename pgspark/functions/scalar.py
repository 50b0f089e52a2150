"""Scalar functions where the semantics differ from Spark's function of that name, and their registry.

``FUNCTIONS`` maps every supported name to a builder of Columns. Names that mean
the same in Spark map to Spark's own function.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pgspark.functions import spatial, vector
from pgspark.operators import paths

#: Unicode white space.
_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
MAX_RANGE = 100_000


# -- comparison and text -------------------------------------------------------


def xor(a: Column, b: Column) -> Column:
    return a != b


def between(x: Column, low: Column, high: Column) -> Column:
    """Null as soon as any side is null, even if the other bound already fails."""
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), x.between(low, high))


def like(s: Column, pattern: str) -> Column:
    """``%`` and ``_`` only: a backslash in the pattern is an ordinary character."""
    return s.like(pattern.replace("\\", "\\\\"))


def trim(s: Column) -> Column:
    return ltrim(rtrim(s))


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, "^" + _WS, "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, _WS + "$", "")


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Positions count from 0; a negative start is 0."""
    at = F.greatest(start, F.lit(0)) + 1
    return F.substring(s, at, F.length(s) if length is None else F.greatest(length, F.lit(0)))


def left(s: Column, n: Column) -> Column:
    return F.left(s, F.greatest(n, F.lit(0)))


def right(s: Column, n: Column) -> Column:
    return F.right(s, F.greatest(n, F.lit(0)))


def float_text(x: Column) -> Column:
    """A double without exponent, and without a fraction if it is whole."""
    whole = (F.abs(x) < 1e18) & (x == F.floor(x))
    return F.when(whole, x.cast("decimal(38,0)").cast("string")).when(F.abs(x) < 1e18, F.regexp_replace(x.cast("decimal(38,17)").cast("string"), r"0+$", "")).otherwise(x.cast("string"))


def text_of(x: Column) -> Column:
    """``to_string``: null becomes the text ``null``."""
    return F.coalesce(x.cast("string"), F.lit("null"))


def to_integer(x: Column) -> Column:
    return F.trim(x.cast("string")).try_cast("long")


def to_float(x: Column) -> Column:
    return F.trim(x.cast("string")).try_cast("double")


def to_boolean(x: Column) -> Column:
    s = F.lower(F.trim(x.cast("string")))
    number = s.try_cast("double")
    return F.when(s == "true", True).when(s == "false", False).when(number.isNotNull(), number != 0)


@F.pandas_udf(StringType())
def _normal(s: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize(f, x) for x, f in zip(s, form)])


def normalize(s: Column, form: str = "NFC") -> Column:
    return _normal(s, F.lit(form))


def is_normalized(s: Column, form: str = "NFC") -> Column:
    return normalize(s, form) == s


def text_match(text: Column, query: Column) -> Column:
    """Every word of the query is a substring of the text, case ignored."""
    return F.forall(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""), lambda w: F.contains(F.lower(text), w))


def trim_of(s: Column, chars: str) -> Column:
    """``TRIM(chars FROM s)``: any of the characters, on both sides."""
    return F.btrim(s, F.lit(chars))


#: Type names, by the beginning of Spark's.
TYPE_NAMES = {"void": "NULL", "boolean": "BOOL", "tinyint": "INT", "smallint": "INT", "int": "INT", "bigint": "INT", "float": "FLOAT", "double": "FLOAT", "decimal": "FLOAT", "string": "STRING", "array<float>": "VECTOR", "array": "LIST", "timestamp_ntz": "LOCAL_DATETIME", "timestamp": "ZONED_DATETIME", "date": "DATE", "interval": "DURATION", "binary": "BYTES", "struct<nodes": "PATH", "struct<type:string,rings": "GEOMETRY", "struct": "RECORD", "map": "RECORD"}


def value_type(x: Column) -> Column:
    """The type's name; ``NULL`` for a null."""
    name = F.lit("RECORD")
    for spark_name, own in reversed(TYPE_NAMES.items()):
        name = F.when(F.startswith(F.typeof(x), F.lit(spark_name)), own).otherwise(name)
    return F.when(x.isNull(), "NULL").otherwise(name)


def is_typed(x: Column, name: str) -> Column:
    """``x IS TYPED name``; a null is of every type."""
    return x.isNull() | (value_type(x) == name.upper())


def size_of(x: Column) -> Column:
    """Elements of a list, edges of a path, characters of a text.

    The type is known when the plan is made, so one branch is left; where it is
    known to the caller too, ``F.size`` and ``F.length`` save the way over JSON.
    """
    json, kind = F.to_json(F.struct(x.alias("v"))), F.typeof(x)
    of = lambda path: F.json_array_length(F.get_json_object(json, path))
    return F.when(F.startswith(kind, F.lit("array")), of("$.v")).when(F.startswith(kind, F.lit("struct")), of("$.v.edges")).otherwise(F.length(F.get_json_object(json, "$.v")))


# -- numbers -------------------------------------------------------------------


def sqrt(x: Column) -> Column:
    """Null for negative numbers."""
    return F.when(x >= 0, F.sqrt(x))


def log(x: Column) -> Column:
    """Natural logarithm; null from 0 down."""
    return F.when(x > 0, F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def round_half_away(x: Column, digits: int = 0) -> Column:
    """``round(x * 10^digits) / 10^digits``, halves away from zero."""
    scaled = x.cast("double") * F.lit(10.0**digits)
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / F.lit(10.0**digits)


def int_divide(a: Column, b: Column) -> Column:
    """Truncates toward zero, in whole numbers throughout; an error for 0."""
    return F.call_function("div", a, b)


def floor_to(x: Column, width: int) -> Column:
    """The multiple of ``width`` at or below a whole number, without passing through a double."""
    return x - F.pmod(x, F.lit(width))


def sign(x: Column) -> Column:
    return F.signum(x).cast("long")


# -- lists ---------------------------------------------------------------------


def head(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def tail(xs: Column) -> Column:
    return F.slice(xs, F.lit(2), F.greatest(F.size(xs), F.lit(1)))


def list_slice(xs: Column, start: Column, stop: Column) -> Column:
    """From 0, the stop excluded, clamped to the list."""
    a = F.greatest(start, F.lit(0))
    return F.slice(xs, a + 1, F.greatest(F.least(stop, F.size(xs)) - a, F.lit(0)))


def int_range(start: Column, stop: Column, step: int = 1) -> Column:
    """Both ends included; empty if the step leads away; at most ``MAX_RANGE`` elements."""
    reach = F.least(stop, start + step * (MAX_RANGE - 1)) if step > 0 else F.greatest(stop, start + step * (MAX_RANGE - 1))
    return F.when((stop >= start) if step > 0 else (stop <= start), F.sequence(start, reach, F.lit(step))).otherwise(F.array().cast("array<int>"))


def list_sort(xs: Column) -> Column:
    """Nulls first."""
    return F.sort_array(xs)


def single(xs: Column, test) -> Column:
    """Exactly one element satisfies the test; null if an unknown element could change that."""
    yes = F.size(F.filter(xs, test))
    unknown = F.size(F.filter(xs, lambda x: test(x).isNull()))
    return F.when(yes > 1, False).when(unknown > 0, None).otherwise(yes == 1)


def all_different(*xs: Column) -> Column:
    items = F.array(*xs)
    return F.size(F.array_distinct(items)) == F.size(items)


def same(*xs: Column) -> Column:
    return F.size(F.array_distinct(F.array(*xs))) <= 1


# -- time ----------------------------------------------------------------------


def extract(part: str, t: Column) -> Column:
    """YEAR to SECOND as whole numbers, and EPOCH seconds."""
    if part.upper() == "EPOCH":
        return F.unix_seconds(t.cast("timestamp"))
    return F.extract(F.lit(part.upper()), t).cast("long")


def date_add_nanos(a: Column, b: Column) -> Column:
    """Sum of two nanosecond counts, held at the ends of the range."""
    total = a.cast("decimal(38,0)") + b.cast("decimal(38,0)")
    return F.greatest(F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")), F.lit(-(1 << 63)).cast("decimal(38,0)")).cast("long")


def date_sub_nanos(a: Column, b: Column) -> Column:
    return date_add_nanos(a, -b.cast("decimal(38,0)"))


def timestamp_to_string(nanos: Column) -> Column:
    """ISO text to the second, in UTC."""
    seconds = int_divide(floor_to(nanos, 1_000_000_000), F.lit(1_000_000_000))
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def duration_between(a: Column, b: Column) -> Column:
    """a minus b."""
    return a - b


def date_plus(day: Column, nanos: Column) -> Column:
    """A date plus a duration stays a date: whole days, rounded down."""
    return F.date_add(day, int_divide(floor_to(nanos, 86_400_000_000_000), F.lit(86_400_000_000_000)).cast("int"))


def duration(text: Column) -> Column:
    """Nanoseconds of an ISO-8601 day-time duration or of a form like ``1h30m``; null for other texts."""
    s = F.lower(F.trim(text))
    iso = r"^-?p(?:[0-9.]+w)?(?:[0-9.]+d)?(?:t(?:[0-9.]+h)?(?:[0-9.]+m)?(?:[0-9.]+s)?)?$"
    short = r"^-?(?:[0-9.]+(?:w|d|h|ms|m|s|us|ns))+$"
    units = {"w": 604_800e9, "d": 86_400e9, "h": 3_600e9, "m": 60e9, "s": 1e9, "ms": 1e6, "us": 1e3, "ns": 1.0}
    total = F.lit(0.0)
    for unit, nanos in units.items():
        after = "(?![a-z])" if len(unit) > 1 else "(?!s)" if unit == "m" else ""
        total = total + F.coalesce(F.nullif(F.regexp_extract(s, rf"([0-9.]+){unit}{after}", 1), F.lit("")).try_cast("double"), F.lit(0.0)) * nanos
    signed = F.when(F.startswith(s, F.lit("-")), -total).otherwise(total)
    return F.when(s.rlike(iso) | s.rlike(short), F.round(signed).cast("long"))


def time_of_day(text: Column) -> Column:
    """Nanoseconds of the day of ``hh:mm[:ss[.fraction]]``; the TIME type is off by default in Spark."""
    part = lambda i: F.regexp_extract(text, r"^([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}(?:\.[0-9]+)?))?$", i)
    seconds = part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + F.coalesce(part(3).try_cast("double"), F.lit(0.0))
    return F.round(seconds * 1e9).cast("long")


def current_time() -> Column:
    """Nanoseconds of the current day, UTC session time."""
    now = F.current_timestamp()
    return (F.unix_micros(now) - F.unix_micros(F.date_trunc("day", now))) * 1000


def zoned_time(text: Column) -> Column:
    """``struct<time, offset_s>``, ``time`` in nanoseconds of the day, of a time with an offset such as ``+02:00`` or ``Z``."""
    part = lambda i: F.regexp_extract(text, r"^([0-9:.]+)(Z|[+-][0-9]{2}:?[0-9]{2})$", i)
    zone = part(2)
    seconds = F.substring(zone, 2, 2).try_cast("int") * 3600 + F.right(zone, F.lit(2)).try_cast("int") * 60
    offset = F.when(zone == "Z", 0).when(F.startswith(zone, F.lit("-")), -seconds).otherwise(seconds)
    return F.when(zone != "", F.struct(time_of_day(part(1)).alias("time"), offset.alias("offset_s")))


FUNCTIONS = {
    # text
    "coalesce": F.coalesce, "char_length": F.char_length, "character_length": F.char_length, "upper": F.upper, "toupper": F.upper, "lower": F.lower, "tolower": F.lower,
    "trim": trim, "ltrim": ltrim, "rtrim": rtrim, "replace": F.replace, "reverse": F.reverse, "substring": substring, "left": left, "right": right,
    "starts_with": F.startswith, "ends_with": F.endswith, "contains": F.contains, "like": like, "normalize": normalize, "is_normalized": is_normalized, "text_match": text_match,
    # conversion
    "to_string": text_of, "tostring": lambda x: x.cast("string"), "float_text": float_text, "tointeger": to_integer, "tofloat": to_float, "toboolean": to_boolean, "double": lambda x: x.cast("double"),
    "value_type": value_type, "is_typed": is_typed, "trim_of": trim_of, "nullif": F.nullif, "null_if": F.nullif,
    # numbers
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": sqrt, "sign": sign, "round": round_half_away, "power": F.power, "log": log, "ln": log, "log10": log10, "exp": F.exp,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "cot": F.cot,
    "degrees": F.degrees, "radians": F.radians, "pi": F.pi, "mod": lambda a, b: a % b, "div": int_divide, "xor": xor, "between": between,
    # lists
    "size": size_of, "length": size_of, "cardinality": F.size, "list_length": F.size, "head": head, "last": last, "tail": tail, "range": int_range,
    "list_contains": F.array_contains, "list_slice": list_slice, "list_append": F.array_append, "list_prepend": F.array_prepend, "list_reverse": F.reverse, "list_sort": list_sort,
    "any": F.exists, "all": F.forall, "none": lambda xs, f: ~F.exists(xs, f), "single": single, "reduce": F.aggregate, "filter": F.filter, "transform": F.transform, "all_different": all_different, "same": same,
    # time
    "now": F.now, "current_timestamp": F.current_timestamp, "current_date": F.current_date, "current_time": current_time, "local_time": current_time, "local_datetime": F.localtimestamp, "local_timestamp": F.localtimestamp,
    "date": F.to_date, "time": time_of_day, "zoned_datetime": F.to_timestamp, "datetime": F.to_timestamp, "extract": extract, "date_add": date_add_nanos, "date_sub": date_sub_nanos, "timestamp_to_string": timestamp_to_string, "duration_between": duration_between,
    "duration": duration, "zoned_time": zoned_time,
    # paths: structs of node and edge lists
    "path_length": lambda p: F.size(p["edges"]), "nodes": lambda p: p["nodes"], "edges": lambda p: p["edges"],
    "is_acyclic": lambda p: paths.is_acyclic(p["nodes"]), "is_trail": lambda p: paths.is_trail(p["edges"]), "is_simple": lambda p: paths.is_simple(p["nodes"]),
    # vectors and shapes
    "cosine_similarity": vector.cosine_similarity, "euclidean_distance": vector.euclidean_distance,
    **spatial.FUNCTIONS,
}
