"""Commit and tag headers."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 4096


class HeaderError(ValueError):
    """kind: no-person, malformed, no-email, no-timestamp, bad-timestamp, no-tree, no-committer, bad-hash or too-long."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


def person_line(header: Column) -> Column:
    """The last author line, else the last committer line, without its keyword; NULL if there is neither."""
    lines = F.split(header, "\n")

    def last(word: str) -> Column:
        return F.try_element_at(F.filter(lines, lambda x: F.startswith(x, F.lit(word + " "))), F.lit(-1))

    return F.when(last("author").isNotNull(), F.substring(last("author"), 8, 1 << 30)).otherwise(F.substring(last("committer"), 11, 1 << 30))


def author(header: Column) -> Column:
    """struct(name, email, epoch, error): error is NULL where the line is well-formed."""
    line = person_line(header)
    close = F.length(line) - F.locate(">", F.reverse(line)) + 1
    before = F.when(F.locate(">", line) > 0, F.substring(line, F.lit(1), close - 1))
    open_ = F.length(before) - F.locate("<", F.reverse(before)) + 1
    after = F.ltrim(F.substring(line, close + 1, F.lit(1 << 30)))
    stamp = F.regexp_extract(after, r"^([^ \t]*)", 1)
    sec = F.when(stamp.rlike(r"^[-+]?[0-9]+$"), stamp.try_cast("bigint"))
    error = (
        F.when(line.isNull(), F.lit("no-person"))
        .when(F.locate(">", line) == 0, F.lit("malformed"))
        .when(F.locate("<", before) == 0, F.lit("no-email"))
        .when(F.ltrim(F.substring(line, close + 1, F.lit(1 << 30))) == "", F.lit("no-timestamp"))
        .when(sec.isNull(), F.lit("bad-timestamp"))
    )
    ok = error.isNull()
    return F.struct(F.when(ok, F.regexp_replace(F.substring(before, F.lit(1), open_ - 1), r"^\s+|\s+$", "")).alias("name"), F.when(ok, F.substring(before, open_ + 1, F.lit(1 << 30))).alias("email"), F.when(ok, sec).alias("epoch"), error.alias("error"))


def parse_author(header: bytes) -> tuple[str, str, int]:
    """Name, email and epoch for use in the source; raises HeaderError."""
    found, is_author = None, False
    for line in header.split(b"\n"):
        if line.startswith(b"author "):
            found, is_author = line[7:], True
        elif line.startswith(b"committer ") and not is_author:
            found = line[10:]
    if found is None:
        raise HeaderError("no-person")
    before, close, after = found.rpartition(b">")
    if not close:
        raise HeaderError("malformed")
    name, open_, email = before.rpartition(b"<")
    if not open_:
        raise HeaderError("no-email")
    after = after.lstrip(b" ")
    if not after:
        raise HeaderError("no-timestamp")
    stamp = re.split(rb"[ \t]", after, maxsplit=1)[0]
    if not re.fullmatch(rb"[-+]?[0-9]+", stamp) or not -(1 << 63) <= int(stamp) < 1 << 63:
        raise HeaderError("bad-timestamp")
    return name.strip().decode("utf-8", "replace"), email.decode("utf-8", "replace"), int(stamp)


def hash_token(text: bytes) -> str | None:
    text = text.strip()[:40]
    return text.decode().lower() if re.fullmatch(rb"[0-9a-fA-F]{40}", text) else None


def commit_header(data: bytes) -> bytes:
    """The header up to the committer line's end, which must come within LIMIT bytes."""
    at = 0 if data.startswith(b"committer ") else data.find(b"\ncommitter ") + 1
    if at == 0 and not data.startswith(b"committer "):
        head = data.split(b"\n\n", 1)[0]
        if len(head) > LIMIT:
            raise HeaderError("too-long")
        return head
    end = data.find(b"\n", at)
    end = len(data) if end < 0 else end
    if end > LIMIT:
        raise HeaderError("too-long")
    return data[:end]


def parse_commit(data: bytes) -> tuple[str, list[str], int]:
    """Tree, parents in order, and committer time; raises HeaderError."""
    tree, parents, when = None, [], None
    for line in data.split(b"\n"):
        if not line:
            break
        if line.startswith((b"tree ", b"parent ")):
            word, _, rest = line.partition(b" ")
            h = hash_token(rest)
            if h is None:
                raise HeaderError("bad-hash")
            if word == b"tree":
                tree = h
            else:
                parents.append(h)
        elif line.startswith(b"committer "):
            fields = line.split()
            if len(fields) < 3 or not re.fullmatch(rb"[-+]?[0-9]+", fields[-2]):
                raise HeaderError("bad-timestamp")
            when = int(fields[-2])
    if tree is None:
        raise HeaderError("no-tree")
    if when is None:
        raise HeaderError("no-committer")
    return tree, parents, when


def tag_target(data: bytes) -> str | None:
    """What an annotated tag points at, if that is a commit or a tag."""
    target = kind = None
    for line in data.split(b"\n"):
        if not line:
            break
        if line.startswith(b"object "):
            target = hash_token(line[7:])
            if target is None:
                raise HeaderError("bad-hash")
        elif line.startswith(b"type "):
            kind = line[5:]
    return target if target and target != "0" * 40 and kind in (None, b"", b"commit", b"tag") else None


def when(epoch: int) -> datetime:
    return datetime.fromtimestamp(epoch, timezone.utc)
