"""Content-derived identities and text locations, as column expressions; all hashes are SHA-1 in lower-case hex."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def blob_id(content: Column) -> Column:
    """SHA-1 of "blob ", the length, a zero byte and the bytes."""
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.char(F.lit(0)))
    return F.sha1(F.concat(head.cast("binary"), content))


def rule_id(pattern: str) -> str:
    return hashlib.sha1(pattern.encode()).hexdigest()


def match_id(rule: Column, blob: Column, start: Column, end: Column) -> Column:
    return F.sha1(F.concat_ws("\0", rule, blob, start.cast("string"), end.cast("string")))


def groups_json(groups: Column) -> Column:
    """Minified JSON array of base64 strings."""
    return F.to_json(F.transform(groups, lambda g: F.regexp_replace(F.base64(g), "[\r\n]", "")))


def finding_id(rule: Column, groups_text: Column) -> Column:
    return F.sha1(F.concat(rule, F.lit("\0"), groups_text))


def _upto(content: Column, n: Column) -> Column:
    return F.decode(F.substring(content, F.lit(1), n.cast("int")), "ISO-8859-1")


def line_of(content: Column, n: Column) -> Column:
    """Line, from 1, of the last of the first n bytes: a line feed already counts for the next line."""
    return (1 + F.length(F.regexp_replace(_upto(content, n), "[^\n]", ""))).cast("long")


def column_of(content: Column, n: Column) -> Column:
    """Bytes since the last line feed or carriage return among the first n bytes."""
    return F.length(F.regexp_replace(_upto(content, n), "(?s)^.*[\r\n]", "")).cast("long")


def lossy(value: Column) -> Column:
    """Bytes as text, malformed UTF-8 replaced."""
    return F.make_valid_utf8(value.cast("string"))


def escaped(value: Column) -> Column:
    """Text for a terminal: control characters but line feed and tab as \\u{..}, escape sequences thus disarmed."""
    chars = F.split(lossy(value), "")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike(r"[\p{Cntrl}&&[^\n\t]]"), F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))).otherwise(c)), "")
