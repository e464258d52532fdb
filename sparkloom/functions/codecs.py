"""Byte codecs of record fields as Column expressions: character sets, zoned, packed and binary numbers, edit pictures, layouts."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.pictures import expand_picture, parse_picture

#: Printable ASCII and its place in code page 037, by the codec's rule.
ASCII = "".join(map(chr, range(32, 127)))
EBCDIC = ASCII.encode("cp037").decode("latin-1")
SPACE_BYTE = 0x40


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def to_ebcdic(s) -> Column:
    """Bytes of a string of printable ASCII; other characters become the substitute 0x3F."""
    clean = F.regexp_replace(s, "[^ -~]", "\u001a")
    return F.encode(F.translate(clean, ASCII + "\u001a", EBCDIC + "?"), "ISO-8859-1")


def from_ebcdic(b) -> Column:
    return F.translate(F.decode(b, "ISO-8859-1"), EBCDIC, ASCII)


def char(n) -> Column:
    """The n-th (from 1) character of the collating sequence."""
    return F.when(_c(n).between(1, 256), from_ebcdic(F.unhex(F.lpad(F.hex(_c(n) - 1), 2, "0"))))


def ordinal(c) -> Column:
    return F.when(F.length(c) == 1, F.conv(F.hex(to_ebcdic(c)), 16, 10).cast("int") + 1)


def alphanumeric(s, size: int, right: bool = False) -> Column:
    """EBCDIC field of ``size`` bytes: padded with spaces or cut, on the right or, justified right, on the left."""
    fitted = F.right(F.lpad(s, F.greatest(F.length(s), F.lit(size)), F.lit(" ")), F.lit(size)) if right else F.rpad(s, size, " ")
    return to_ebcdic(fitted)


def digits(value, total: int, decimals: int) -> Column:
    """The ``total`` digits of a numeric string, aligned at the point; what does not fit is cut on either side."""
    clean = F.regexp_replace(_c(value).cast("string"), "^[+-]+", "")
    whole = F.substring_index(clean, ".", 1)
    n = total - decimals
    out = F.right(F.lpad(whole, F.greatest(F.length(whole), F.lit(n)), F.lit("0")), F.lit(n)) if n else F.lit("")
    if decimals:
        fraction = F.when(F.contains(clean, F.lit(".")), F.substring_index(clean, ".", -1)).otherwise("")
        out = F.concat(out, F.rpad(fraction, decimals, "0"))
    return F.regexp_replace(out, "[^0-9]", "0")


def sign_nibble(value, signed: bool) -> Column:
    """F without sign, D for what is negative and not zero, else C (in hexadecimal)."""
    if not signed:
        return F.lit("F")
    v = _c(value).cast("string")
    return F.when(F.startswith(v, F.lit("-")) & v.rlike("[1-9]"), "D").otherwise("C")


def zoned(value, total: int, decimals: int, signed: bool) -> Column:
    d = digits(value, total, decimals)
    sign = F.when(d.rlike("[1-9]"), sign_nibble(value, signed)).otherwise(F.lit("C" if signed else "F"))
    head = F.regexp_replace(F.substring(d, 1, total - 1), "([0-9])", "F$1")
    return F.unhex(F.concat(head, sign, F.right(d, F.lit(1))))


def from_zoned(b, decimals: int) -> Column:
    h = F.hex(b)
    n = F.regexp_replace(h, ".(.)", "$1").cast("decimal(38,0)")
    n = F.when(F.substr(h, F.length(h) - 1, F.lit(1)) == "D", -n).otherwise(n)
    return n.cast("double") / float(10**decimals)


def packed(value, total: int, decimals: int, signed: bool) -> Column:
    d = digits(value, total, decimals)
    sign = F.when(d.rlike("[1-9]"), sign_nibble(value, signed)).otherwise(F.lit("C" if signed else "F"))
    return F.unhex(F.lpad(F.concat(d, sign), 2 * (total // 2 + 1), "0"))


def from_packed(b, decimals: int) -> Column:
    h = F.hex(b)
    n = F.substr(h, F.lit(1), F.length(h) - 1).cast("decimal(38,0)")
    return F.when(F.right(h, F.lit(1)) == "D", -n).otherwise(n).cast("double") / float(10**decimals)


def binary_size(total: int) -> int:
    return 2 if total <= 4 else 4 if total <= 9 else 8


def _pack(x: pd.Series, double: pd.Series) -> pd.Series:
    v = x.to_numpy("float64", na_value=np.nan)
    wide, narrow = v.astype(">f8").tobytes(), v.astype(">f4").tobytes()
    return pd.Series([None if bad else wide[8 * i : 8 * i + 8] if d else narrow[4 * i : 4 * i + 4] for i, (bad, d) in enumerate(zip(np.isnan(v), double))], dtype=object)


def _unpack(b: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=b.index, dtype="float64")
    size = b.map(len, na_action="ignore")
    for n, kind in ((8, ">f8"), (4, ">f4")):
        out[size == n] = np.frombuffer(b"".join(b[size == n]), kind).astype("float64")
    return out


def float_bytes(x, double) -> Column:
    """IEEE bytes, big-endian: 4, or 8 where ``double``."""
    return F.pandas_udf(_pack, T.BinaryType())(x, double)


def bytes_float(b) -> Column:
    return F.pandas_udf(_unpack, T.DoubleType())(b)


def blank_when_zero(field, value, size: int) -> Column:
    return F.when(_c(value).cast("string").try_cast("double") == 0, F.unhex(F.lit("40" * size))).otherwise(field)


# pictures
def apply_picture(value, pic: str) -> Column:
    """A number in a picture of 9, Z, comma, point, B, 0, / and a leading or trailing sign: zeros before the first
    significant digit become spaces under Z, insertions among them too."""
    p = expand_picture(pic)
    sign = p[0] if p[0] in "+-" else p[-1] if p[-1] in "+-" else ""
    body = p.strip("+-")
    point = body.find(".")
    whole = body if point < 0 else body[:point]
    tail = "" if point < 0 else body[point + 1 :]
    n, k = sum(c in "9Z" for c in whole), sum(c in "9Z" for c in tail)
    d = digits(_c(value).cast("string"), n + k, k)
    first = F.length(F.regexp_extract(F.substring(d, 1, n), "^(0*)", 1))  # zeros before the first digit
    out, i = [], 0
    forced = whole.find("9")
    for at, c in enumerate(whole):
        floating = forced < 0 or at < forced
        if c in "9Z":
            here = F.substring(d, i + 1, 1)
            out.append(F.when(first > i, F.lit(" ")).otherwise(here) if c == "Z" and floating else here)
            i += 1
        else:
            mark = " " if c == "B" else c
            out.append(F.when(first >= i, F.lit(" ")).otherwise(F.lit(mark)) if floating else F.lit(mark))
    if point >= 0:
        out.append(F.lit("."))
        for c in tail:
            if c in "9Z":
                out.append(F.substring(d, i + 1, 1))
                i += 1
            else:
                out.append(F.lit(" " if c == "B" else c))
    text = F.concat(*out)
    if sign:
        negative = F.startswith(_c(value).cast("string"), F.lit("-")) & d.rlike("[1-9]")
        s = F.when(negative, F.lit("-")).otherwise(F.lit("+" if sign == "+" else " "))
        text = F.concat(s, text) if p[0] in "+-" else F.concat(text, s)
    return text


# layouts
def layout(fields: list[tuple]) -> list[dict]:
    """Offsets of (level, name, picture or '', occurs, redefines or '') fields in order; groups have no picture."""
    out: list[dict] = []
    stack: list[dict] = []
    at = 0
    for level, name, pic, occurs, redefines in fields:
        while stack and stack[-1]["level"] >= level:
            g = stack.pop()
            if not g["pic"]:
                g["size"] = at - g["offset"]
                at = g["offset"] + g["size"] * g["occurs"]
        if redefines:
            at = next(f["offset"] for f in out if f["name"] == redefines)
        f = {"level": level, "name": name, "pic": pic, "occurs": occurs or 1, "offset": at, "size": parse_picture(pic)["size"] if pic else 0}
        out.append(f)
        stack.append(f)
        at += f["size"] * f["occurs"]
    while stack:
        g = stack.pop()
        if not g["pic"]:
            g["size"] = at - g["offset"]
            at = g["offset"] + g["size"] * g["occurs"]
    return out


def field(record, f: dict, index: int = 0) -> Column:
    """The bytes of a field (or one of its occurrences) of a record."""
    return F.substring(record, f["offset"] + index * f["size"] + 1, f["size"])
