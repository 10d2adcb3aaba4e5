"""Temperature mixing: source shares to a power found by bisection, then weights realised as budgeted permutations of blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Of the entropy of equal shares.
TARGET_ENTROPY = 0.97
MAX_REPEATS = 4.0
BLOCK_TOKENS = 1 << 20
SEED = 17


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def powered(tokens: list[int], a: float) -> list[float]:
    """Shares to the power a, in proportion; sources without tokens get nothing."""
    top = max([*tokens, 1])
    w = [(n / top) ** a if n > 0 else 0.0 for n in tokens]
    return [x / sum(w) for x in w] if sum(w) else w


def weights(tokens: list[int], budget: float, target: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, steps: int = 60) -> tuple[float, list[float]]:
    """The exponent and the weights. Entropy falls and repetition falls as the exponent goes from 0 (equal weights) to 1 (shares as they are).

    Wanted: entropy target * log(sources) as nearly as [0, 1] allows, but no source read more than max_repeats times.
    """
    some = sum(n > 0 for n in tokens)
    goal = target * math.log(some) if some > 1 else 0.0

    def bisect(good) -> float:
        low, high = 0.0, 1.0
        if good(low):
            return low
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if good(mid) else (mid, high)
        return high

    a = bisect(lambda x: entropy(powered(tokens, x)) <= goal)
    b = bisect(lambda x: all(w * budget <= max_repeats * n for w, n in zip(powered(tokens, x), tokens)))
    a = max(a, b)
    return a, powered(tokens, a)


def n_tokens(text: Column) -> Column:
    """What budgets are counted in: pieces between single white-space characters (space, tab, line ends), 0 for NULL or empty text."""
    bare = text
    for c in " \n\t\r":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.length(text) - F.length(bare) + 1).cast("long")


def _key(*parts) -> Column:
    return F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


#: Sources up to which their schedule is broadcast, a row of about 100 bytes each.
BROADCAST_SOURCES = 100_000


def running(df: DataFrame, by: list[str], order: list[str], value: str, tag: str) -> DataFrame:
    """df with sofar, the sum of value over the rows before it among those of its key, in this order; keys aren't NULL.

    Rows are cut into ranges of (key, order), ties by chance, so that no task holds a key: sums of ranges come first, then those within.
    """
    tie = "__tie"
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by, *order, tie)
    parted = cut(ranged.withColumn("__part", F.spark_partition_id()), tag)
    sums = parted.groupBy(*by, "__part").agg(F.sum(value).alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    heads = sums.select(*by, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy(*order, tie).rowsBetween(Window.unboundedPreceding, -1))
    out = parted.withColumn("__within", F.coalesce(within, F.lit(0))).join(heads, [*by, "__part"])
    return out.withColumn("sofar", F.col("__before") + F.col("__within")).drop(tie, "__part", "__before", "__within")


def _placed(df: DataFrame, seed: int) -> DataFrame:
    """Rows (doc_id, epoch, blocks, ...) with the block that they fall into in their epoch, and their place there."""
    bin_ = F.pmod(_key(seed + 1, F.col("epoch"), F.col("doc_id")), F.col("blocks"))
    return df.withColumn("place", _key(seed, F.col("epoch"), F.col("doc_id"))).withColumn("block", _key(seed + 2, F.col("epoch"), bin_))


def _schedule(rows: DataFrame, budget: int | None, target: float, max_repeats: float, block_tokens: int, seed: int) -> DataFrame:
    """For each source (name, number src): whole epochs (full), what is left of its budget (rest), blocks, and the block of the last epoch in which the budget is reached (edge) with the tokens before it."""
    by = rows.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy("source").collect()
    total = sum(r["tokens"] for r in by)
    budget = total if budget is None else budget
    _, w = weights([r["tokens"] for r in by], budget, target, max_repeats)
    shares = []
    for k, (r, x) in enumerate(zip(by, w)):
        own = x * budget
        full = int(own // r["tokens"]) if r["tokens"] else 0
        shares.append((r["source"], k, full, own - full * r["tokens"], max(1, round(r["tokens"] / block_tokens))))
    spark, fields = rows.sparkSession, "name string, src int, full int, rest double, blocks long"
    spec = spark.createDataFrame(shares, fields)
    last = _placed(_with(rows, spec, len(shares)).where("rest > 0").withColumn("epoch", F.col("full")), seed)
    sums = last.groupBy("src", "rest", "block").agg(F.sum("tokens").alias("size"))
    over = running(sums, ["src"], ["block"], "size", "blocks").where("sofar + size > rest OR sofar >= rest")
    edges = {r["src"]: r for r in over.groupBy("src").agg(F.min(F.struct("block", "sofar")).alias("e")).select("src", "e.block", "e.sofar").collect()}
    rows = [(*s, edges[s[1]]["block"] if s[1] in edges else None, float(edges[s[1]]["sofar"]) if s[1] in edges else 0.0) for s in shares]
    return spark.createDataFrame(rows, f"{fields}, edge long, spent double")


def _with(df: DataFrame, spec: DataFrame, sources: int) -> DataFrame:
    spec = F.broadcast(spec) if sources <= BROADCAST_SOURCES else spec
    return df.join(spec, df["source"].eqNullSafe(spec["name"])).drop("name")


def _read(df: DataFrame, spec: DataFrame, seed: int) -> DataFrame:
    """df (doc_id, source, tokens, ...) as often as it is read, with epoch, block and place: one pass, and one over the blocks in which budgets end."""
    times = F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0)
    e = _with(df, spec, spec.count()).withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    e = _placed(e, seed)
    last = F.col("epoch") == F.col("full")
    cols = [*df.columns, "epoch", "block", "place"]
    whole = e.where(~last | F.col("edge").isNull() | (F.col("block") < F.col("edge")))
    edge = running(e.where(last & (F.col("block") == F.col("edge"))), ["src"], ["place", "doc_id"], "tokens", "edges")
    return whole.select(cols).union(edge.where("spent + sofar < rest").select(cols))


def _light(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), n_tokens(docs[text_col]).alias("tokens")]


def plan(docs: DataFrame, budget: int | None = None, target: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, epoch, block, place): which documents are read in which epoch of their source, and in what order.

    A source's budget is its weight times budget (all tokens by default). Its whole epochs take every document; the last
    one takes whole blocks in permuted order until the budget is reached, and of the block in which that happens the
    documents up to the first that fills it, in permuted order. A block is a hash range of about block_tokens tokens;
    (block, place) order an epoch. Running sums cover blocks first and then one block's documents, each cut into ranges,
    so no task holds a source, nor an id that many rows share. Sources are counted on the driver, a number each.
    Sources with a NULL name are one source; rows with a NULL id or an id that repeats are read each, and those alike share
    a place, in any order; texts without words count 0 tokens and go with whole epochs and blocks; texts of any length are
    counted whole; other columns don't matter; an empty table gives an empty result.
    """
    rows = cut(docs.select(*_light(docs, id_col, text_col, source_col)), "tokens")
    return _read(rows, _schedule(rows, budget, target, max_repeats, block_tokens, seed), seed).select("doc_id", "source", "epoch", "block", "place")


def mixed(docs: DataFrame, budget: int | None = None, target: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_plan: bool = False) -> DataFrame:
    """docs as the plan reads them: the plan's rows with all columns of docs as they are, in order of epoch, block and place (with_plan: these three as well).

    Rows are placed by expressions and the schedule alone, so docs is joined with nothing that grows with it; one shuffle
    puts rows in order, in ranges, and each file written from the result holds its range in order. So copies of one document,
    which are in different epochs, are far apart. Rows without an id, and rows that repeat an id in one source or several,
    are read as any other, and count in the budget. Texts of any length stay whole; a NULL text counts no tokens;
    columns keep their names whatever they are; an empty table gives an empty result.
    """
    light = _light(docs, id_col, text_col, source_col)
    rows = cut(docs.select(*light), "tokens")
    spec = _schedule(rows, budget, target, max_repeats, block_tokens, seed)
    whole = docs.select(*light, F.struct(*(docs[c].alias(c) for c in docs.columns)).alias("__doc"))
    order = ["epoch", "block", "place", "__tie"]
    out = _read(whole, spec, seed).withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return out.select("__doc.*", *(order[:3] if with_plan else []))
