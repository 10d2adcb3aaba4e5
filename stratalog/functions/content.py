"""Content-address expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blob_oid(data: Column, kind: str = "blob") -> Column:
    """Object id of a content: SHA-1 over "<kind> <bytes>\\0" and the bytes. NULL stays NULL."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit(f"{kind} "), F.octet_length(data).cast("string")), "utf-8"), F.lit(b"\0"), data.cast("binary")))


def to_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def from_hex(s: Column) -> Column:
    """Twenty bytes from forty hex digits; NULL for anything else."""
    return F.when(s.rlike("^[0-9a-fA-F]{40}$"), F.unhex(s))


def is_absent(oid: Column) -> Column:
    """True for a missing side, written as NULL or as forty zeros."""
    return oid.isNull() | (oid == "0" * 40)


def shard_key(oid: Column) -> Column:
    """The first eight bytes of an id as an unsigned number in a decimal."""
    return F.conv(F.substring(oid, 1, 16), 16, 10).cast("decimal(20,0)")


def is_binary(data: Column, window: int = 8192) -> Column:
    """True where a NUL byte lies in the first window bytes."""
    return F.coalesce(F.contains(F.substring(data.cast("binary"), 1, window), F.lit(b"\0")), F.lit(False))


def guess_type(data: Column) -> Column:
    """The kind of object that a bare content looks like; a blob if nothing speaks against it."""
    d = data.cast("binary")
    starts = lambda w: F.startswith(d, F.lit(w.encode()))
    return F.when(starts("tree "), "tree").when(starts("parent ") | starts("author "), "commit").when(starts("tag "), "tag").otherwise("blob")
