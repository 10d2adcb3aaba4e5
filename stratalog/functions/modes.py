"""File modes, object types and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TREE, BLOB, LINK, MODULE = 0o040000, 0o100000, 0o120000, 0o160000
TYPES = {0: "bad", 1: "commit", 2: "tree", 3: "blob", 4: "tag", 6: "ofs-delta", 7: "ref-delta"}


def kind(mode: Column) -> Column:
    """The type bits of a mode."""
    return mode.bitwiseAND(0o170000)


def is_tree(mode: Column) -> Column:
    return kind(mode) == TREE


def is_blob_like(mode: Column) -> Column:
    """Regular files and symbolic links."""
    return kind(mode).isin(BLOB, LINK)


def type_name(code: Column) -> Column:
    out = F.lit("unknown")
    for k, v in TYPES.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def join_path(prefix: Column, name: Column) -> Column:
    return F.when(F.coalesce(prefix, F.lit("")) == "", name).otherwise(F.concat(prefix, F.lit("/"), name))


def slashes(path: Column) -> Column:
    """Paths use forward slashes already where Spark runs."""
    return path


def shown(path: Column) -> Column:
    """A path as text: itself where it is valid UTF-8, otherwise its bytes in hexadecimal, quoted, so that different paths stay different."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.hex(path.cast("binary")), "(..)", "\\\\x$1"), F.lit('"'))
    return F.when(F.is_valid_utf8(path), path).otherwise(quoted)
