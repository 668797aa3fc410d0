"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt by hash into source blocks. How many rows of each block go to each shard is
drawn before any row moves: a uniform shuffle into shards of given sizes implies one exact
distribution of these counts, a multivariate hypergeometric one for each block given the
others. A binary tree draws it. A node holds a run of blocks and, per shard, the number of
rows that come from there; the left half's counts are drawn by halving the shards in turn,
each time one hypergeometric number. Leaves are the rows of the matrix, whose sums are the
block sizes and the shard sizes exactly.

Then rows move twice: to their block, where they are ordered by a hash (the local
permutation) and the matrix row cuts the order into shards, and to their shard, where they
are ordered by another hash. A shard is ordered in chunks of hash ranges, so neither a block
nor a shard is ever one task's whole work; a row's slot is its chunk's start plus its rank.

All of it is DataFrame expressions. Draws come from hashes of (seed, node), so reruns and
retries agree, whatever the table's file splits.

The hypergeometric draw is Devroye's rejection method for log-concave distributions: a hat
that is flat around the mode with exponential tails holds for every such distribution; the
mass at x relative to the mode is a difference of log factorials, taken so that nothing
large cancels.

The law is ``rows``: shard sizes differ by one at most. Groups of equal texts are no unit:
all rows are shuffled alike.

Defined results: null and empty texts, null ids, very long texts and columns of any name
(kept in a struct) are rows like all others; of rows equal in every column it is not told
which goes where (rows equal beyond a block's size are dealt by position, stored first);
with fewer rows than shards some shards are empty; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from strata.llm.tables import every
from strata.session import save, save_counted

SHARDS, SEED = 24, 12
BLOCK_ROWS, MAX_BLOCKS, MATRIX = 512, 1 << 16, 1 << 21
CHUNK_ROWS = 1 << 16
_HOT = 4096
_TOP = 5  # tree levels grown in one task
_TRIES = 256  # a try fails with a chance of at most about 0.8


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.transform(F.array(value), f)[0]


def _uniform(*key: Column) -> Column:
    """A number in (0, 1) that the key decides."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) * 2.0**-53


def _tail(x: Column) -> Column:
    """Stirling's series beyond its leading terms, to 10^-10 from 7 on."""
    square = x * x
    return (1.0 / 12 - (1.0 / 360 - 1.0 / 1260 / square) / square) / x


def _rising(x: Column) -> Column:
    """(x + 1) ... (x + 6)"""
    product = x + 1
    for k in range(2, 7):
        product = product * (x + k)
    return product


def _sum(numbers: Column, f) -> Column:
    """The sum of ``f`` over an array; ``f`` stands in the expression once."""
    return F.aggregate(numbers, F.lit(0.0), lambda total, x: total + f(x))


def _log_ratio(p: Column) -> Column:
    """ln(b! / a!) of a pair, accurate however large both are."""

    def moved(q: Column) -> Column:
        x, y = q["x"], q["y"]
        rising = F.log(_rising(y - 7) / _rising(x - 7))
        return (x - 0.5) * F.log1p((y - x) / x) + (y - x) * (F.log(y) - 1) + _tail(y) - _tail(x) - rising

    return _let(F.struct((p["a"] + 7).alias("x"), (p["b"] + 7).alias("y")), moved)


def _log_factorial(p: Column) -> Column:
    """sign * ln(a!)"""
    x = p["a"] + 7
    return p["sign"] * ((x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + _tail(x) - F.log(_rising(p["a"])))


def hypergeometric(good: Column, bad: Column, sample: Column, *key: Column) -> Column:
    """Of ``sample`` rows drawn without replacement from good and bad ones, the number of good ones."""

    def bounded(p: Column) -> Column:
        g, b, s = p["g"], p["b"], p["s"]
        low, high = F.greatest(F.lit(0.0), s - b), F.least(g, s)
        mode = F.greatest(low, F.least(high, F.floor((g + 1) * (s + 1) / (g + b + 2)).cast("double")))
        return _let(F.struct(g.alias("g"), b.alias("b"), s.alias("s"), low.alias("low"), high.alias("high"), mode.alias("m")), drawn)

    def drawn(p: Column) -> Column:
        return F.when(p["low"] == p["high"], p["low"]).otherwise(_let(peak(p), lambda q: accepted(p, q)))

    def peak(p: Column) -> Column:
        """A little below the mode's mass, which makes a valid hat; log factorials of large numbers are less exact."""
        g, b, s, m = p["g"], p["b"], p["s"], p["m"]
        n = g + b
        variance = s * (g / n) * (b / n) * (n - s) / F.greatest(n - 1, F.lit(1.0))
        plus, minus = [g, b, s, n - s], [m, g - m, s - m, b - s + m, n]
        terms = [F.struct(F.lit(1.0).alias("sign"), a.alias("a")) for a in plus]
        terms += [F.struct(F.lit(-1.0).alias("sign"), a.alias("a")) for a in minus]
        mass = F.exp(_sum(F.array(*terms), _log_factorial))
        return 0.9 * F.when(variance > 10_000, 1 / F.sqrt(2 * math.pi * variance)).otherwise(F.least(F.lit(1.0), mass))

    def accepted(p: Column, q: Column) -> Column:
        def attempt(i: Column) -> Column:
            flat = 1 + q / 2
            u = [_uniform(*key, i, F.lit(j)) for j in range(4)]
            away = F.when(u[0] <= flat / (1 + flat), u[1] * flat / q).otherwise((flat - F.log(u[1])) / q)
            return _let(F.struct(away.alias("away"), (u[2] < 0.5).alias("up"), u[3].alias("u")), placed)

        def placed(t: Column) -> Column:
            step = F.floor(t["away"] + 0.5).cast("double")
            x = p["m"] + F.when(t["up"], step).otherwise(-step)
            hat = F.least(F.lit(1.0), F.exp(1 + q / 2 - q * t["away"]))
            return _let(F.struct(x.alias("x"), (t["u"] * hat).alias("under")), judged)

        def judged(t: Column) -> Column:
            x, m = t["x"], p["m"]
            pairs = [(m, x), (p["g"] - m, p["g"] - x), (p["s"] - m, p["s"] - x)]
            pairs.append((p["b"] - p["s"] + m, p["b"] - p["s"] + x))
            terms = F.array(*(F.struct(a.alias("a"), b.alias("b")) for a, b in pairs))
            inside = (x >= p["low"]) & (x <= p["high"])
            return F.when(inside, F.when(t["under"] <= F.exp(-_sum(terms, _log_ratio)), x))

        first = F.aggregate(
            F.sequence(F.lit(1), F.lit(_TRIES)),
            F.lit(None).cast("double"),
            lambda got, i: F.when(got.isNotNull(), got).otherwise(attempt(i)),
        )
        return F.coalesce(first, p["m"])

    numbers = F.struct(good.cast("double").alias("g"), bad.cast("double").alias("b"), sample.cast("double").alias("s"))
    return _let(numbers, bounded).cast("long")


def _total(counts: Column, first: Column, width: Column) -> Column:
    return F.aggregate(F.slice(counts, first + 1, width), F.lit(0).cast("long"), lambda a, c: a + c)


def split_counts(counts: Column, sample: Column, shards: int, *key: Column) -> Column:
    """A multivariate hypergeometric draw: of ``counts`` (array, a power of two long), ``sample`` in all."""
    depth = max(0, math.ceil(math.log2(shards)))
    if not depth:
        return F.array(sample)

    def halve(drawn: Column, width: Column) -> Column:
        def halves(of: Column, i: Column) -> Column:
            good, bad = _total(counts, 2 * i * width, width), _total(counts, (2 * i + 1) * width, width)
            return _let(hypergeometric(good, bad, of, *key, width, i), lambda n: F.array(n, of - n))

        return F.flatten(F.transform(drawn, halves))

    # From all shards down to single ones; a width is the shards in half a node.
    widths = F.array(*(F.lit(1 << k) for k in reversed(range(depth))))
    return F.aggregate(widths, F.array(sample), halve)


def _grown(levels: int, shards: int, seed: int) -> Column:
    """The nodes below (block, rows, counts) after ``levels`` levels."""
    node = F.struct("block", "rows", "counts")
    if not levels:
        return F.array(node)

    def children(n: Column) -> Column:
        half = (F.size(n["rows"]) / 2).cast("int")
        sample = _total(n["rows"], F.lit(0), half)
        left = split_counts(n["counts"], sample, shards, F.lit(seed), half, n["block"])
        return _let(left, lambda drawn: F.array(
            F.struct(
                (n["block"] * 2).alias("block"), F.slice(n["rows"], 1, half).alias("rows"), drawn.alias("counts")
            ),
            F.struct(
                (n["block"] * 2 + 1).alias("block"),
                F.slice(n["rows"], half + 1, half).alias("rows"),
                F.zip_with(n["counts"], drawn, lambda c, l: c - l).alias("counts"),
            ),
        ))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(levels)), F.array(node), lambda nodes, _: F.flatten(F.transform(nodes, children))
    )


def matrix(blocks: DataFrame, n_blocks: int, sizes: list[int], seed: int = SEED) -> DataFrame:
    """(block, counts): the communication matrix. ``blocks`` has (block, n); ``sizes`` are the shards'.

    The tree's top is grown in one task, what is below each of its nodes in a task of its own.
    """
    depth, shards = max(0, math.ceil(math.log2(n_blocks))), len(sizes)
    padded = sizes + [0] * ((1 << max(0, math.ceil(math.log2(shards)))) - shards)
    # At most MAX_BLOCKS numbers, in block order; blocks without rows have none.
    at = F.map_from_entries(F.collect_list(F.struct("block", "n"))).alias("at")
    filled = F.transform(
        F.sequence(F.lit(0), F.lit((1 << depth) - 1)), lambda b: F.coalesce(F.try_element_at("at", b), F.lit(0).cast("long"))
    )
    root = blocks.select(F.col("block").cast("int").alias("block"), "n").agg(at).select(
        F.lit(0).alias("block"), filled.alias("rows"), F.array(*(F.lit(s).cast("long") for s in padded)).alias("counts")
    )
    top = min(depth, _TOP)
    nodes = save(root.select(F.inline(_grown(top, shards, seed))), "matrix-top")
    below = nodes.repartition(1 << top, "block").select(F.inline(_grown(depth - top, shards, seed)))
    return below.select("block", F.slice("counts", 1, shards).alias("counts"))


def _hashable(name: str, kind: DataType) -> Column:
    def has_map(t: DataType) -> bool:
        if isinstance(t, StructType):
            return any(has_map(f.dataType) for f in t.fields)
        return has_map(t.elementType) if isinstance(t, ArrayType) else isinstance(t, (MapType, VariantType))

    column = F.col(name)
    return F.to_json(F.struct(column)) if has_map(kind) else column


def _keyed(rows: DataFrame, n: int, n_blocks: int, seed: int) -> DataFrame:
    """Rows with ``key``, a hash of all columns; rows equal beyond a block's size are told apart by position."""
    inner = rows.schema["row"].dataType
    columns = [_hashable(f"row.`{f.name.replace('`', '``')}`", f.dataType) for f in inner.fields]
    keyed = rows.withColumn("key", F.xxhash64(F.lit(seed), *columns))
    limit = max(4 * BLOCK_ROWS, 4 * n // n_blocks, n // _HOT)
    same, found = save_counted(keyed.groupBy("key").count().where(F.col("count") > limit).select("key"), "same")
    if not found:
        return keyed
    # Fewer than _HOT keys.
    stored = save(keyed.withColumn("at", F.monotonically_increasing_id()), "numbered")
    apart = F.when(F.col("hot"), F.xxhash64("key", "at")).otherwise(F.col("key"))
    marked = stored.join(F.broadcast(same.withColumn("hot", F.lit(True))), "key", "left")
    return marked.select("row", apart.alias("key"))


def shuffle_rows(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(row, shard, slot): all columns of ``rows`` in the struct ``row``, its shard, its place there from 0."""
    packed = rows.select(F.struct(*every(rows)).alias("row"))
    n = rows.count()
    n_blocks = max(1, min(math.ceil(n / BLOCK_ROWS), MAX_BLOCKS, max(1, MATRIX // shards)))
    keyed = _keyed(packed, n, n_blocks, seed).withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(n_blocks)).cast("int"))
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    drawn = matrix(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")), n_blocks, sizes, seed)
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda k: F.aggregate(F.slice("counts", F.lit(1), k), F.lit(0).cast("long"), lambda a, c: a + c))
    drawn = save(drawn.select("block", ends.alias("ends")), "matrix")

    # Permute within the block, and cut the order by the matrix (at most MATRIX numbers, broadcast).
    local = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("key", F.lit(seed + 2)), "key"))
    placed = keyed.withColumn("rank", local).join(F.broadcast(drawn), "block")
    shard = F.size(F.filter("ends", lambda e: e < F.col("rank")))
    chunks = max(1, math.ceil(n / shards / CHUNK_ROWS))
    again = F.xxhash64("key", "rank", F.lit(seed + 3))
    moved = save(
        placed.select("row", shard.cast("int").alias("shard"), again.alias("order"), F.col("key")).withColumn(
            "chunk", F.floor((F.shiftrightunsigned("order", 11).cast("double") * 2.0**-53) * chunks).cast("int")
        ),
        "sharded",
    )

    # Permute within the shard: chunks are ranges of the order's upper bits, as unsigned numbers.
    counts = moved.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("order", "key")) - 1
    ranked = moved.withColumn("within", rank).join(starts, ["shard", "chunk"])
    return ranked.select("row", "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"))
