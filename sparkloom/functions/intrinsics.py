"""Record-processing functions as Column expressions, all on the JVM side.

Where an argument is not of the right kind the value is null ("uncomputable"). Names follow the functions
of the language they come from; 0-based positions where the lists and strings of the machine
are meant, 1-based ones for the intrinsic functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_ZERO = "1600-12-31"
CUTOFF = 50


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# bytes and nibbles
def nibble_get(b, high: bool) -> Column:
    return F.shiftright(_c(b), 4).bitwiseAND(15) if high else _c(b).bitwiseAND(15)


def nibble_set(b, high: bool, n) -> Column:
    return F.shiftleft(_c(n), 4).bitwiseOR(_c(b).bitwiseAND(15)) if high else _c(b).bitwiseAND(240).bitwiseOR(_c(n).bitwiseAND(15))


def byte_from_int(n) -> Column:
    return _c(n).bitwiseAND(255)


def int_from_byte(b) -> Column:
    return _c(b).cast("int")


def int_to_binary_bytes(n, size: int) -> Column:
    """Big-endian two's complement of ``size`` bytes."""
    return F.unhex(F.right(F.lpad(F.hex(_c(n).cast("bigint")), 16, "0"), F.lit(2 * size)))


def binary_bytes_to_int(b, size: int) -> Column:
    """The signed value of ``size`` big-endian bytes (up to 7; 8 by two's complement of the halves)."""
    high = F.conv(F.hex(F.substring(b, 1, max(1, size - 4) if size > 4 else size)), 16, 10).cast("bigint")
    top = max(1, size - 4) if size > 4 else size
    signed = F.when(high >= (1 << (8 * top - 1)), high - (1 << (8 * top))).otherwise(high)
    if size <= 4:
        return signed
    return signed * (1 << 32) + F.conv(F.hex(F.substring(b, top + 1, 4)), 16, 10).cast("bigint")


# lists
def list_get(a, i) -> Column:
    return F.get(a, _c(i))


def list_set(a, i, v) -> Column:
    return F.transform(a, lambda x, k: F.when(k == _c(i), _c(v)).otherwise(x))


def list_len(a) -> Column:
    return F.size(a)


def list_slice(a, start, end) -> Column:
    return F.slice(a, _c(start) + 1, F.greatest(_c(end) - _c(start), F.lit(0)))


def list_concat(a, b) -> Column:
    return F.concat(a, b)


def make_list(n, v) -> Column:
    return F.array_repeat(_c(v), _c(n))


# strings
def string_find(s, needle) -> Column:
    return F.locate(needle, s) - 1 if isinstance(needle, str) else F.instr(s, needle) - 1


def _quoted(*delimiters: str) -> str:
    return "|".join("\\Q" + d + "\\E" for d in delimiters if d)


def string_split(s, delimiter: str) -> Column:
    return F.split(s, _quoted(delimiter))


def multi_delimiter_split(s, *delimiters: str) -> Column:
    """Split at the nearest of the delimiters; of two at one place the first named."""
    return F.split(s, _quoted(*delimiters)) if any(delimiters) else F.array(s)


def multi_delimiter_consumed_length(s, count: int, *delimiters: str) -> Column:
    """Characters up to and with the ``count``-th delimiter; the whole length if there are fewer."""
    if not any(delimiters):
        return F.length(s)
    head = F.regexp_extract(s, f"^(?s)((?:.*?(?:{_quoted(*delimiters)})){{{count}}})", 1)
    return F.when(F.size(F.split(s, _quoted(*delimiters))) > count, F.length(head)).otherwise(F.length(s)) if count else F.lit(0)


def string_count(s, pattern: str, mode: str = "all") -> Column:
    if mode == "characters":
        return F.length(s)
    if not pattern:
        return F.lit(0)
    if mode == "leading":
        return (F.length(F.regexp_extract(s, f"^((?:{_quoted(pattern)})*)", 1)) / len(pattern)).cast("int")
    return ((F.length(s) - F.length(F.replace(s, F.lit(pattern), F.lit("")))) / len(pattern)).cast("int")


def string_replace(s, old: str, new: str, mode: str = "all") -> Column:
    """``leading`` tests the replaced text again, so it is defined only where ``new`` does not begin with ``old``."""
    if not old:
        return s
    if mode == "all":
        return F.replace(s, F.lit(old), F.lit(new))
    at = F.locate(old, s)
    if mode == "first":
        return F.when(at > 0, F.concat(F.substring(s, 1, at - 1), F.lit(new), F.substr(s, at + len(old)))).otherwise(s)
    if new.startswith(old):
        raise ValueError("a leading replacement that begins with what it replaces never ends")
    if new == "":
        return F.regexp_replace(s, f"^(?:{_quoted(old)})+", "")
    return F.when(F.startswith(s, F.lit(old)), F.concat(F.lit(new), F.substr(s, F.lit(len(old) + 1)))).otherwise(s)


def boundary_split(s, boundary: str, kind: str) -> Column:
    """[the part before or after the first ``boundary``, the rest]; all and nothing if it is absent."""
    at = F.locate(boundary, s)
    if kind == "before":
        found = F.array(F.substring(s, 1, at - 1), F.substr(s, at))
    else:
        found = F.array(F.substr(s, at + len(boundary)), F.substring(s, 1, at + len(boundary) - 1))
    return F.when(at == 0, F.array(s, F.lit(""))).otherwise(found)


def boundary_slice(s, boundary: str, kind: str) -> Column:
    return boundary_split(s, boundary, kind)[0]


def string_slice(s, start, length) -> Column:
    return F.substr(s, _c(start) + 1, _c(length))


def string_splice(s, start: int, length: int, new) -> Column:
    return F.concat(F.substring(s, 1, start), _c(new), F.substr(s, F.lit(start + length + 1)))


def string_zfill(s, width: int) -> Column:
    sign = F.regexp_extract(s, "^[+-]", 0)
    body = F.substr(s, F.length(sign) + 1)
    return F.when(F.length(s) >= width, s).otherwise(F.concat(sign, F.lpad(body, F.lit(width) - F.length(sign), F.lit("0"))))


def string_convert(s, old: str, new: str) -> Column:
    return F.translate(s, old, new)


def concatenate(*parts) -> Column:
    return F.concat(*map(_c, parts))


def substitute(s, *pairs: str) -> Column:
    for old, new in zip(pairs[::2], pairs[1::2]):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def string_concat(parts) -> Column:
    return F.array_join(parts, "")


def is_numeric(s) -> Column:
    return s.rlike("^[0-9]+$")


def is_alphabetic(s) -> Column:
    return s.rlike("^[\\p{L} ]*$")


def is_alphabetic_lower(s) -> Column:
    return s.rlike("^[\\p{Ll} ]*$")


def is_alphabetic_upper(s) -> Column:
    return s.rlike("^[\\p{Lu} ]*$")


upper_case, lower_case, reverse, length = F.upper, F.lower, F.reverse, F.length


def trim(s, side: str = "both") -> Column:
    return {"both": F.trim, "leading": F.ltrim, "trailing": F.rtrim}[side](s)


def current_date() -> Column:
    """21 characters: date, time to hundredths, +0000."""
    return F.concat(F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSS"), F.lit("+0000"))


# numbers in text
def numval(s) -> Column:
    """Sign before or after, CR or DB behind; blank is 0; null if it is no number."""
    t = F.upper(F.trim(s))
    credit = t.rlike("(CR|DB)$")
    t = F.trim(F.regexp_replace(t, "(CR|DB)$", ""))
    lead = F.regexp_extract(t, "^[+-]", 0)
    t = F.trim(F.substr(t, F.length(lead) + 1))
    tail = F.regexp_extract(t, "[+-]$", 0)
    t = F.replace(F.trim(F.substr(t, F.lit(1), F.length(t) - F.length(tail))), F.lit(" "), F.lit(""))
    minus = credit.cast("int") + (lead == "-").cast("int") + (tail == "-").cast("int")
    value = F.when(t.rlike("^([0-9]+\\.?[0-9]*|\\.[0-9]+)$"), t.try_cast("decimal(38,10)"))
    return F.when(t == "", F.lit(0).cast("decimal(38,10)")).otherwise(F.when(minus % 2 == 1, -value).otherwise(value))


def numval_c(s) -> Column:
    return numval(F.translate(s, "$,", ""))


def test_numval(s) -> Column:
    """0 for a valid argument, else the first place that cannot begin or go on a number (its length + 1 if it breaks off)."""
    ok = F.length(F.regexp_extract(F.upper(s), r"^( *[+-]? *(?:[0-9]*(?:\.[0-9]*)?)? *(?:[+-]|C|CR|D|DB)? *)", 1))
    return F.when(numval(s).isNotNull(), 0).otherwise(ok + 1)


def test_numval_c(s) -> Column:
    """As :func:`test_numval`, with a currency sign and commas."""
    ok = F.length(F.regexp_extract(F.upper(s), r"^( *[+-]? *\$? *(?:[0-9,]*(?:\.[0-9]*)?)? *(?:[+-]|C|CR|D|DB)? *)", 1))
    valid = numval_c(s).isNotNull() & F.upper(s).rlike(r"^ *[+-]? *\$? *[0-9,]*(\.[0-9]*)? *([+-]|CR|DB)? *$")
    return F.when(valid, 0).otherwise(ok + 1)


# dates: whole numbers of days since 1600-12-31
def integer_of_date(yyyymmdd) -> Column:
    return F.date_diff(F.try_to_date(_c(yyyymmdd).cast("string"), "yyyyMMdd"), F.lit(DAY_ZERO).cast("date"))


def date_of_integer(n) -> Column:
    return F.date_format(F.date_add(F.lit(DAY_ZERO).cast("date"), _c(n).cast("int")), "yyyyMMdd").cast("int")


def day_of_integer(n) -> Column:
    d = F.date_add(F.lit(DAY_ZERO).cast("date"), _c(n).cast("int"))
    return F.year(d) * 1000 + F.dayofyear(d)


def integer_of_day(yyyyddd) -> Column:
    y = F.floor(_c(yyyyddd) / 1000).cast("int")
    d = F.date_add(F.make_date(y, F.lit(1), F.lit(1)), (_c(yyyyddd) % 1000 - 1).cast("int"))
    return F.when((_c(yyyyddd) % 1000 >= 1) & (F.year(d) == y), F.date_diff(d, F.lit(DAY_ZERO).cast("date")))


def year_to_yyyy(yy, cutoff: int = CUTOFF) -> Column:
    return F.when(_c(yy) >= cutoff, F.lit(1900)).otherwise(2000) + _c(yy)


def date_to_yyyymmdd(yymmdd, cutoff: int = CUTOFF) -> Column:
    return year_to_yyyy(F.floor(_c(yymmdd) / 10000).cast("int"), cutoff) * 10000 + _c(yymmdd) % 10000


def day_to_yyyyddd(yyddd, cutoff: int = CUTOFF) -> Column:
    return year_to_yyyy(F.floor(_c(yyddd) / 1000).cast("int"), cutoff) * 1000 + _c(yyddd) % 1000


# arithmetic
def mod(x, y) -> Column:
    """Floored: the result has the divisor's sign."""
    return _c(x) - _c(y) * F.floor(F.try_divide(_c(x), _c(y)))


def rem(x, y) -> Column:
    """Truncated: the result has the dividend's sign."""
    return F.try_mod(_c(x), _c(y))


def integer(x) -> Column:
    return F.floor(_c(x))


def integer_part(x) -> Column:
    return _c(x).cast("bigint")


def fraction_part(x) -> Column:
    return _c(x) - _c(x).cast("bigint")


def sqrt(x) -> Column:
    return F.when(_c(x) >= 0, F.sqrt(_c(x)))


def asin(x) -> Column:
    return F.when(F.abs(_c(x)) <= 1, F.asin(_c(x)))


def acos(x) -> Column:
    return F.when(F.abs(_c(x)) <= 1, F.acos(_c(x)))


def log(x) -> Column:
    return F.when(_c(x) > 0, F.ln(_c(x)))


def log10(x) -> Column:
    return F.when(_c(x) > 0, F.log10(_c(x)))


def exp10(x) -> Column:
    return F.pow(F.lit(10.0), _c(x))


def factorial(n) -> Column:
    """Exact to 33! in 38 digits; null for what is negative or larger."""
    return F.when(_c(n).between(0, 33), F.aggregate(F.sequence(F.lit(1), F.greatest(_c(n).cast("int"), F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x.cast("decimal(2,0)")).cast("decimal(38,0)")))


def cobol_round(x, digits: int) -> Column:
    """Half away from zero."""
    return F.round(_c(x).cast(f"decimal(38,{max(digits + 4, 8)})"), digits)


def annuity(rate, n) -> Column:
    r = _c(rate)
    return F.when(r == 0, F.try_divide(F.lit(1.0), _c(n))).otherwise(r / (1 - F.pow(1 + r, -_c(n))))


def present_value(rate, *values) -> Column:
    return reduce(lambda a, b: a + b, [_c(v) / F.pow(1 + _c(rate), F.lit(i + 1)) for i, v in enumerate(values)])


abs_, sin, cos, tan, atan, exp, random = F.abs, F.sin, F.cos, F.tan, F.atan, F.exp, F.rand


# statistics of an argument list
def maximum(*xs) -> Column:
    return F.array_max(F.array(*xs))


def minimum(*xs) -> Column:
    return F.array_min(F.array(*xs))


def total(*xs) -> Column:
    return reduce(lambda a, b: a + b, map(_c, xs))


def range_(*xs) -> Column:
    return maximum(*xs) - minimum(*xs)


def mean(*xs) -> Column:
    return total(*xs) / len(xs)


def median(*xs) -> Column:
    """Of the values that are there; null without any."""
    s = F.sort_array(F.array_compact(F.array(*xs)))
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2)) + F.get(s, F.floor(n / 2))) / 2


def midrange(*xs) -> Column:
    return (maximum(*xs) + minimum(*xs)) / 2


def variance(*xs) -> Column:
    """Of a sample; one value has variance 0. Nulls are left out; null with fewer than two values left.

    One pass by Welford's updates, in the order of the values: the last digits are those of DuckDB's ``var_samp``, and sums of large squares do not cancel.
    """
    if len(xs) == 1:
        return xs[0] * 0

    def add(s, x):
        n = s["n"] + 1
        to = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), to.alias("mean"), (s["squares"] + (x - to) * (x - s["mean"])).alias("squares"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return F.aggregate(F.array_compact(F.array(*[_c(x).cast("double") for x in xs])), zero, add, lambda s: F.when(s["n"] > 1, s["squares"] / (s["n"] - 1)))


def ord_max(*xs) -> Column:
    return F.array_position(F.array(*xs), maximum(*xs))


def ord_min(*xs) -> Column:
    return F.array_position(F.array(*xs), minimum(*xs))
