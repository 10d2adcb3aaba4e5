"""Exact duplicates: within a partition by length and content hash, full byte strings go into a Patricia trie whose ends keep the smallest id."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, shared_dir

BROADCAST_BYTES = 64 << 20
#: Rows and bytes of one (length, hash) beyond which it is settled in salted parts.
HOT, HOT_BYTES = 20_000, 64 << 20
#: What a node takes in memory besides its label, about.
NODE = 400


class Node:
    """An edge with what lies under it. weight: bytes of the whole subtree in memory. An owner of None is no end; ends without an id have NOBODY."""

    __slots__ = ("kids", "label", "owner", "weight")

    def __init__(self, label: bytes, owner, kids: dict):
        self.label, self.owner, self.kids, self.weight = label, owner, kids, NODE + len(label)


NOBODY = (1 << 63) - 1


class Trie:
    """Compressed radix trie over byte strings; all of a partition's strings are in one.

    Beyond budget bytes, the heaviest subtree of at most half the budget is written to the store, at whatever depth it lies;
    a number stays in its place. Strings that lead there bring it back. Memory is the budget, and the nodes that the string
    at hand leads through.
    """

    def __init__(self, budget: int = 64 << 20, spill=None):
        self.root = Node(b"", None, {})
        self.root.weight = 0
        self.budget, self.spill, self.last = budget, spill, 0

    @property
    def weight(self) -> int:
        return self.root.weight

    def put(self, key: bytes, value: int | None) -> int | None:
        """The smallest value put with this key so far; None if there was none but None."""
        value = NOBODY if value is None else value
        node, path = self.root, [self.root]
        while key:
            kid = node.kids.get(key[0])
            if isinstance(kid, int):
                kid = node.kids[key[0]] = self._unpacked(self.spill.load(kid)[0])
                for x in path:
                    x.weight += kid.weight
            if kid is None:
                kid = node.kids[key[0]] = Node(key, None, {})
                for x in path:
                    x.weight += kid.weight
                key = b""
            elif key.startswith(kid.label):
                key = key[len(kid.label) :]
            else:
                n = len(commonprefix([kid.label, key]))
                upper = Node(kid.label[:n], None, {kid.label[n]: kid})
                kid.label, kid.weight = kid.label[n:], kid.weight - n
                upper.weight += kid.weight
                node.kids[key[0]] = kid = upper
                for x in path:
                    x.weight += NODE
                key = key[n:]
            node = kid
            path.append(node)
        node.owner = value if node.owner is None else min(node.owner, value)
        if self.spill and self.weight > self.budget:
            self._lighten()
        return None if node.owner == NOBODY else node.owner

    def _lighten(self) -> None:
        """Spills until a half of the budget is left."""
        while self.weight > self.budget // 2:
            path, node, first = [], self.root, 0
            while path == [] or node.weight > self.budget // 2:
                heavy = max((b for b, k in node.kids.items() if isinstance(k, Node)), key=lambda b: node.kids[b].weight, default=None)
                if heavy is None:
                    break
                path.append(node)
                first, node = heavy, node.kids[heavy]
            self.last += 1
            self.spill.save(self.last, self._packed(node), node.weight)
            path[-1].kids[first] = self.last
            for x in path:
                x.weight -= node.weight

    @staticmethod
    def _packed(node: Node) -> list[tuple]:
        """The subtree as a flat list, parents first: (parent's place, first byte, label and owner, or number of what is away)."""
        out, todo = [], [(-1, 0, node)]
        while todo:
            parent, first, at = todo.pop()
            if isinstance(at, int):
                out.append((parent, first, at))
                continue
            out.append((parent, first, at.label, at.owner))
            todo.extend((len(out) - 1, b, k) for b, k in at.kids.items())
        return out

    @staticmethod
    def _unpacked(rows: list[tuple]) -> Node:
        made: list[Node | None] = []
        for parent, first, *rest in rows:
            made.append(None if len(rest) == 1 else Node(rest[0], rest[1], {}))
            if parent >= 0:
                made[parent].kids[first] = rest[0] if len(rest) == 1 else made[-1]
        for k in range(len(rows) - 1, 0, -1):
            if made[k] is not None:
                made[rows[k][0]].weight += made[k].weight
        return made[0]


class Spill:
    """Subtrees in the shared folder, by number, under a name of this task's own."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, root = fs.FileSystem.from_uri(folder)
        self.root = f"{root}/trie-{uuid.uuid4().hex}"
        self.made = False

    def save(self, number: int, rows: list, size: int) -> None:
        if not self.made:
            self.store.create_dir(self.root, recursive=True)
            self.made = True
        with self.store.open_output_stream(f"{self.root}/{number}") as f:
            f.write(pickle.dumps((rows, size)))

    def load(self, number: int):
        with self.store.open_input_stream(f"{self.root}/{number}") as f:
            got = pickle.loads(f.read())
        self.store.delete_file(f"{self.root}/{number}")
        return got

    def close(self) -> None:
        if self.made:
            self.store.delete_dir(self.root)
            self.made = False


def _owners(folder: str, budget: int, *keys: str, heads: bool = False):
    """Owners in the order of rows that come sorted by keys and id; one trie for the task's rows, or, salted, for each part, as parts mustn't know of each other.

    heads: also the number of the text within its part, and the text itself with its first row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spill = Spill(folder)
        trie, part, seen = Trie(budget, spill), None, {}
        try:
            for b in batches:
                out, number, texts = [], [], []
                for i, t, *key in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", *keys))):
                    if heads and key != part:
                        spill.close()
                        trie, part, seen = Trie(budget, spill), key, {}
                    out.append(o := trie.put(t, i))
                    if heads:
                        # rows come by id, so a text's owner never changes; texts with equal keys are told apart by the trie's owner, or are those without any id
                        k = (o, None if o is not None else t)
                        texts.append(None if k in seen else t)
                        number.append(seen.setdefault(k, len(seen)))
                cols = [b.column("doc_id"), pa.array(out, pa.int64()), *(b.column(c) for c in keys)]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(number, pa.int32()), pa.array(texts, pa.binary())] if heads else [])], names=["doc_id", "owner_id", *keys, *(["number", "text"] if heads else [])])
        finally:
            spill.close()

    return run


def exact_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 64 << 20, hash_bits: int = 64, broadcast_bytes: int = BROADCAST_BYTES, hot: int = HOT, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, owner_id) for each row: owner_id is the smallest id among rows with exactly the same text.

    A first pass counts (length, hash) without moving any text; only texts whose pair repeats are shuffled by it, sorted
    by id, and compared in full in a trie for each partition. So the smallest id comes first and no row is held back. Pairs
    with more than hot rows or hot_bytes bytes are first settled in salted parts, whose owners then meet. The repeated pairs
    are broadcast up to broadcast_bytes and joined by shuffle beyond.
    A NULL text equals nothing: its row owns itself. A row without an id never owns another and gets the owner of its
    text, or NULL where no row with the text has an id. Rows that repeat an id each get a row. The empty text is a text;
    texts of any length are compared whole, up to one and the budget in a task's memory. Other columns don't matter; an
    empty table gives an empty result. hash_bits below 64 is for tests: more strings meet.
    """
    spark = docs.sparkSession
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    keyed = src.select("doc_id", F.octet_length("text").alias("len"), (F.xxhash64("text") if hash_bits == 64 else F.pmod(F.xxhash64("text"), F.lit(1 << hash_bits))).alias("hash"), "text")
    known = keyed.where("text IS NOT NULL")
    pairs = cut(known.groupBy("len", "hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "pairs")
    parts = F.ceil(F.greatest(F.col("n") / hot, F.col("n") * F.col("len") / hot_bytes, F.lit(1.0))).cast("int")
    repeated = cut(pairs.where("n > 1").select("len", "hash", F.when((F.col("n") > hot) | (F.col("n") * F.col("len") > hot_bytes), parts).otherwise(1).alias("parts")), "repeated")
    many, top = repeated.select(F.count("*"), F.coalesce(F.max("parts"), F.lit(1))).first()
    found = known.join(F.broadcast(repeated) if many * 24 <= broadcast_bytes else repeated, ["len", "hash"])
    found = found.select("len", "hash", "parts", "doc_id", F.encode(F.col("text"), "utf-8").alias("text"))
    folder, by_id = shared_dir(spark), F.asc_nulls_last("doc_id")

    def settle(df: DataFrame, *more: str) -> DataFrame:
        fields = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in more)
        return df.repartition("len", "hash").sortWithinPartitions("len", "hash", by_id).mapInArrow(lean(_owners(folder, budget, *more)), "doc_id long, owner_id long" + fields)

    settled = settle(found.where("parts = 1")).select("doc_id", "owner_id")
    if top > 1:
        # a number for the row, not its id, as a hot text may be under one id
        salted = found.where("parts > 1").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts")).cast("int"))
        keys = ("len", "hash", "salt")
        part = cut(salted.repartition(*keys).sortWithinPartitions(*keys, by_id).mapInArrow(lean(_owners(folder, budget, *keys, heads=True)), "doc_id long, owner_id long, len int, hash long, salt int, number int, text binary"), "salted")
        own = [*keys, "number"]
        heads = part.where("text IS NOT NULL").select(*own, F.col("owner_id").alias("doc_id"), "text")
        upper = settle(heads, *own).select(*own, "owner_id")
        settled = settled.union(part.select("doc_id", *own).join(upper, own).select("doc_id", "owner_id"))
    alone = pairs.where("n = 1").select(F.col("least").alias("doc_id"), F.col("least").alias("owner_id"))
    blank = src.where("text IS NULL").select("doc_id", F.col("doc_id").alias("owner_id"))
    return settled.union(alone).union(blank)


ORACLE = "SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS owner_id FROM documents"
