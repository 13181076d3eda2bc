"""Columns over file content (binary): magic bytes, encoding, entropy, encryption signs, hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD, HASHED = 4096, 65536
UNKNOWN, UTF8, UTF16_LE, UTF16_BE, ASCII, LATIN1 = range(6)


def head(content: Column, n: int = HEAD) -> Column:
    return F.substring(content, 1, n)


def _begins(content: Column, hex_: str) -> Column:
    return F.hex(F.substring(content, 1, len(hex_) // 2)) == hex_


def magic(content: Column) -> Column:
    return F.lower(F.hex(head(content, 4)))


def is_binary(content: Column, n: int = 1024) -> Column:
    """A zero byte among the first."""
    return F.instr(F.decode(head(content, n), "ISO-8859-1"), "\0") > 0


def encoding(content: Column) -> Column:
    first = head(content, 1024)
    ascii_ = ~F.decode(first, "ISO-8859-1").rlike(r"[\x{80}-\x{FF}]")
    return (
        F.when(_begins(content, "EFBBBF"), UTF8)
        .when(_begins(content, "FFFE"), UTF16_LE)
        .when(_begins(content, "FEFF"), UTF16_BE)
        .when(ascii_, ASCII)
        .when(F.is_valid_utf8(first), UTF8)
        .otherwise(LATIN1)
    )


def entropy(content: Column) -> Column:
    """Bits a byte over the first 4 KB, four places; 0 below eight bytes. One term for each distinct byte, without a row for each byte."""

    def bits(text: Column) -> Column:
        n = F.length(text)
        share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
        kinds = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
        return -F.aggregate(F.transform(kinds, share), F.lit(0.0), lambda a, p: a + p * F.log2(p))

    # the decoded text is bound once, as the element of an array
    once = F.get(F.transform(F.array(F.decode(head(content), "ISO-8859-1")), bits), F.lit(0))
    return F.when(F.octet_length(content) < 8, 0.0).otherwise(F.round(once, 4))


def encrypted(content: Column, bits: Column) -> Column:
    text = F.decode(head(content), "ISO-8859-1")
    signed = F.startswith(text, F.lit("-----BEGIN PGP")) | F.startswith(text, F.lit("Salted__")) | _begins(content, "8502") | _begins(content, "8C0D")
    zipped = _begins(content, "504B0304") & (F.ascii(F.substring(text, 7, 1)) % 2 == 1)
    pdf = F.startswith(text, F.lit("%PDF-")) & F.contains(text, F.lit("/Encrypt"))
    return signed | zipped | pdf | ((bits > 7.5) & (F.octet_length(head(content)) >= 1024))


def content_hash(content: Column) -> Column:
    """SHA-256 of the first 64 KB; empty for an empty file."""
    return F.when(F.octet_length(content) == 0, F.lit("")).otherwise(F.sha2(head(content, HASHED), 256))


def full_hash(content: Column, bits: int = 256) -> Column:
    return F.sha2(content, bits)
