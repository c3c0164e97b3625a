"""Column expressions on sequences and small parsers."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(seq: Column, start: Column | int = 1, end: Column | int = 0) -> Column:
    """Symbols start..end, counted from 1, both inclusive; an end of 0 is the last symbol."""
    s, e = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    last = F.when(e == 0, F.char_length(seq)).otherwise(e)
    return F.when(last >= s, F.substring(seq, s, last - s + 1)).otherwise(F.raise_error(F.lit("decreasing trim range")))


def reverse(seq: Column) -> Column:
    return F.reverse(seq)


def complement(seq: Column) -> Column:
    """A-Z in upper case, A with T and C with G exchanged, everything else kept."""
    return F.translate(F.translate(seq, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "ATCG", "TAGC")


def reverse_complement(seq: Column) -> Column:
    return reverse(complement(seq))


def clear_n(seq: Column) -> Column:
    """N in lower case, which equals no N of another sequence; nothing is removed."""
    return F.translate(seq, "N", "n")


def accession(header: Column) -> Column:
    """Text between the third and fourth bar of a header, or else the whole header."""
    h = F.regexp_replace(header, r"^>|[\r\n].*$", "")
    parts = F.split(h, r"\|")
    return F.when(F.size(parts) > 4, F.get(parts, F.lit(3))).otherwise(h)


def parse_size(text: str) -> int:
    """'0', or a number with K, M or G (powers of 1024)."""
    if text.strip() == "0":
        return 0
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?)([KMG])\s*", text.upper())
    if not m:
        raise ValueError(f"not a size: {text}")
    return int(float(m[1]) * 1024 ** (" KMG".index(m[2])))


def parse_weights(text: str) -> list[int]:
    """'N' for N equal weights, or a list of positive weights; fewer than 32."""
    w = [int(x) for x in text.split(",")]
    w = [1] * w[0] if len(w) == 1 else w
    if not w or min(w) <= 0 or len(w) >= 32:
        raise ValueError(f"not weights: {text}")
    return w


def expand(path: str) -> str:
    return os.path.expandvars(path)


def varint(n: int) -> bytes:
    """Base-128, most significant group first, continuation bit on all but the last."""
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(out[::-1])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    while True:
        b = data[at]
        at += 1
        n = n << 7 | b & 0x7F
        if not b & 0x80:
            return n, at
