"""Token counts: vocabulary strings proven to encode alone as one token are counted as they stand, the rest is merged."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Memo, lean, pieces, roomy, slices, spread

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_encoders: dict = {}


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Byte-pair merges of one pre-token, lowest rank first, leftmost first among equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


_proven: dict = {}


def proven(path: str, pattern: str = PATTERN) -> frozenset[str]:
    """What prove_whole() finds in a vocabulary file, made once in this process: the driver proves, and tasks are given the set."""
    if (path, pattern) not in _proven:
        _proven[path, pattern] = frozenset(prove_whole(ranks_of(path), pattern))
    return _proven[path, pattern]


def prove_whole(ranks: dict[bytes, int], pattern: str = PATTERN) -> set[str]:
    """Vocabulary strings that the pattern leaves whole and whose merges end in that one token."""
    pat = regex.compile(pattern)
    proven = set()
    for b in ranks:
        try:
            s = b.decode()
        except UnicodeDecodeError:
            continue
        if pat.fullmatch(s) and pat.findall(s) == [s] and merge(b, ranks) == [b]:
            proven.add(s)
    return proven


class Encoder:
    """Counts or encodes by pieces between spaces."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        self.path = path
        self.ranks = ranks_of(path)
        self.full = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.by_spaces = pattern == PATTERN
        self.wide = max(self.ranks.values()) > 0xFFFF
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self._whole: frozenset[str] | None = None
        self.spaced = np.zeros(max(self.ranks.values()) + 1, bool)
        self.spaced[[r for b, r in self.ranks.items() if b[:1] == b" "]] = True
        self.merged = Memo(lambda p: len(self.full._encode_single_piece(p)))

    @property
    def whole(self) -> frozenset[str]:
        if self._whole is None:
            self._whole = proven(self.path, self.pattern.pattern)
        return self._whole

    @whole.setter
    def whole(self, strings: frozenset[str]) -> None:
        self._whole = strings

    def pretokens(self, text: str) -> int:
        """One for each pre-token that is a proven vocabulary string; the number of merged parts for the others."""
        return sum(1 if p in self.whole else self.merged[p] for p in self.pattern.findall(text))

    def ids(self, text: str) -> bytes:
        return np.array(self.full._core_bpe.encode_ordinary(text), self.dtype).tobytes()

    def _apart(self, col: pa.Array) -> tuple:
        """Piece codes, pieces by text, strings, and which texts must be taken at once: a piece that begins with white space may interact with its neighbours."""
        code, n, parts = pieces(col)
        odd = np.fromiter((p == "" or p[0].isspace() for p in parts), bool, len(parts))
        first = np.cumsum(n) - n
        hit = odd[code]
        hit[first] = [parts[c] == "" for c in code[first]]
        return code, n, first, parts, np.logical_or.reduceat(hit, first)

    def counts(self, col: pa.Array) -> np.ndarray:
        """Token counts; NULL counts 0. A single space before anything but white space always begins a pre-token, so each distinct piece is counted once."""
        if not self.by_spaces:
            return np.array([self.pretokens(t or "") for t in col.to_pylist()], np.int64)
        out = np.zeros(len(col), np.int64)
        for start, part in slices(col):
            code, n, first, parts, once = self._apart(part)
            whole, merged, each = self.whole, self.merged, []
            for p in self.pattern.findall(" " + " ".join(p if p and not p[0].isspace() else "-" for p in parts)):
                k = 1 if p in whole else merged[p]
                if p[0] == " ":
                    each.append(k)
                else:
                    each[-1] += k
            each = np.asarray(each, np.int64)[code]
            each[first] = [0 if o else self.pretokens(parts[c]) for c, o in zip(code[first], once)]
            total = np.add.reduceat(each, first)
            for i in np.flatnonzero(once):
                total[i] = self.pretokens(part[int(i)].as_py() or "")
            out[start : start + len(part)] = total
        return out

    def encode(self, col: pa.Array) -> Iterator[bytes]:
        """Ids of each text, cut at spaces in the same way; NULL gives no ids."""
        if not self.by_spaces:
            yield from (self.ids(t or "") for t in col.to_pylist())
            return
        for _, part in slices(col, 4_500_000):
            code, n, first, parts, once = self._apart(part)
            ids = np.array(self.full._core_bpe.encode_ordinary(" " + " ".join(p if p and not p[0].isspace() else "-" for p in parts)), self.dtype)
            at = np.flatnonzero(self.spaced[ids])
            size = np.diff(np.append(at, len(ids)))
            for i, (f, k) in enumerate(zip(first.tolist(), n.tolist())):
                if once[i]:
                    yield self.ids(part[i].as_py() or "")
                else:
                    c = code[f + 1 : f + k]
                    yield self.ids(parts[code[f]]) + ids[spread(at[c], size[c])].tobytes()


def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    """One for each Python worker, kept from task to task."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens), a row for each input row, equal to the length of the full encoding.

    vocabulary: a file of base64 tokens and ranks, at the same path on every executor. NULL text counts NULL, empty
    text 0; ids may be NULL or repeat; other columns don't matter; an empty table gives an empty result. Whole texts
    of any length. The proof is made before the job, on the driver, and sent along: less than a megabyte for 50,000 tokens, and
    no larger than the vocabulary file. No shuffle, but of tables too small for the cores: each task reads two columns and writes two numbers a row.
    """
    src = roomy(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(proven(vocabulary, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        enc.whole = shared.value
        for b in batches:
            n = pc.if_else(b.column(1).is_valid(), pa.array(enc.counts(b.column(1))), pa.scalar(None, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=["doc_id", "n_tokens"])

    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long")
