"""Picture clauses in plain Python."""

from __future__ import annotations

import re


def expand_picture(pic: str) -> str:
    return re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), pic.upper())


def parse_picture(pic: str) -> dict:
    """kind, digits, decimals, signed, size of a picture clause."""
    p = expand_picture(pic)
    if set(p) & set("XA"):
        return {"kind": "alphanumeric", "digits": 0, "decimals": 0, "signed": False, "size": len(p)}
    edited = bool(set(p) & set("Z*$+-,.B0/")) or p.endswith(("CR", "DB"))
    point = p.replace(".", "V").find("V")
    tail = p[point + 1 :] if point >= 0 else ""
    return {"kind": "edited" if edited else "zoned", "digits": sum(c in "9Z*" for c in p), "decimals": sum(c in "9Z*" for c in tail), "signed": "S" in p or edited and bool(set(p) & set("+-")), "size": len(p) if edited else sum(c == "9" for c in p)}


#: Figurative constants and the byte that each repeats.
FIGURATIVE = {
    "ZERO": b"0", "ZEROS": b"0", "ZEROES": b"0", "SPACE": b" ", "SPACES": b" ", "HIGH-VALUE": b"\xff", "HIGH-VALUES": b"\xff", "LOW-VALUE": b"\x00", "LOW-VALUES": b"\x00",
    "QUOTE": b'"', "QUOTES": b'"', "NULL": b"\x00", "NULLS": b"\x00",
}


def figurative(name: str, size: int):
    """A figurative constant, or ``ALL 'literal'``, as the bytes that fill a field of ``size``."""
    from pyspark.sql import functions as F

    every = re.fullmatch(r"(?i)ALL\s+['\"](.+)['\"]", name)
    unit = every[1].encode() if every else FIGURATIVE[name.upper()]
    return F.lit(bytearray((unit * size)[:size]))
