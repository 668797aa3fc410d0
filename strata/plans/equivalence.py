"""Structural equivalence: vertices with the same neighbours, exactly or nearly.

Nothing here lists the pairs of a neighbourhood. Equal sets are found by fingerprint,
nearly equal ones through the rare elements of a set (prefix filtering), and a vertex stops
looking as soon as no candidate left can rank before the one it has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.keys import key_merge
from strata.operators import graph
from strata.operators.explore import with_key_columns
from strata.session import save, save_counted

_MAX_ROUNDS = 50
# Sizes up to this have a class of their own; above, a class spans a factor of 1.25.
_EXACT_SIZES = 12
_SIZE_RATIO = 1.25
_SLOTS = 32
_FIRST_BLOCK = 64
_BLOCK_GROWTH = 8
# Spark applies a row-number limit before the shuffle up to this many rows by default.
_LAST_BLOCK = 1000
# Containment: sets that come to a node are compared up to so many, and elements followed so far.
_NODE = 1000
_DEPTH = 16


def _sets(edges: DataFrame, symmetric: bool) -> DataFrame:
    """(id, side, nbr) with side 0 = out, 1 = in; a symmetric graph needs only one side."""
    if symmetric:
        return edges.select(
            F.col("src").alias("id"), F.lit(0).alias("side"), F.col("dst").alias("nbr")
        )
    sides = F.array(
        F.struct(F.col("src").alias("id"), F.lit(0).alias("side"), F.col("dst").alias("nbr")),
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("side"), F.col("src").alias("nbr")),
    )
    return edges.select(F.inline(sides))


def twin_representatives(sets: DataFrame) -> DataFrame:
    """(id, rep, n_out, n_in): the least id among all vertices with exactly the same sets.

    Sets are compared by size and a 128-bit fingerprint, then element by element against
    the representative's; members that turn out different go through another round with
    new hash seeds, so the result is exact.
    """
    done = None
    rest = sets
    for seed in range(_MAX_ROUNDS):
        prints = rest.groupBy("id").agg(
            F.bit_xor(F.xxhash64("side", "nbr", F.lit(seed))).alias("h1"),
            F.bit_xor(F.xxhash64(F.lit(seed), "nbr", "side")).alias("h2"),
            F.count_if(F.col("side") == 0).alias("n_out"),
            F.count_if(F.col("side") == 1).alias("n_in"),
        )
        prints = save(prints, "prints")
        same = ["h1", "h2", "n_out", "n_in"]
        reps = prints.groupBy(*same).agg(F.min("id").alias("rep"))
        assigned = save(prints.join(reps, same).select("id", "rep", "n_out", "n_in"), "twins")
        twins = assigned.where("id <> rep").select("id", "rep")
        of_rep = rest.withColumnRenamed("id", "rep").join(
            twins.select("rep").distinct(), "rep", "left_semi"
        )
        wrong = (
            rest.join(twins, "id")
            .join(of_rep, ["rep", "side", "nbr"], "left_anti")
            .select("id")
            .distinct()
        )
        wrong, n = save_counted(wrong, "collisions")
        done = assigned if done is None else done.unionByName(assigned)
        if n == 0:
            return done
        done = done.join(wrong, "id", "left_anti")
        rest = rest.join(wrong, "id", "left_semi")
    raise RuntimeError("neighbour sets could not be told apart")


def structural(
    edges: DataFrame, vertices: DataFrame | None = None, levels: int = 4
) -> DataFrame:
    """Vertices with identical out- and in-sets form one cluster, named by its least id.
    Isolated vertices keep their own id."""
    edges = save(graph.distinct_edges(edges), "edges")
    vertices = graph.endpoints(edges) if vertices is None else vertices
    reps = twin_representatives(_sets(edges, symmetric=False)).select("id", "rep")
    own = F.array_repeat(F.col("id"), levels - 1)
    keys = vertices.select("id").join(reps, "id", "left").select(
        "id", F.concat(F.array(F.coalesce("rep", "id")), own).alias("key")
    )
    return with_key_columns(keys, levels)


def _tokens(sets: DataFrame, sizes: DataFrame, twins: DataFrame | None = None) -> DataFrame:
    """The elements of the sets of ``sizes`` with all that the search needs of them: (id,
    side, nbr, weight, n_out, n_in, freq), freq counting the sets that hold the element there.

    With ``twins`` (id, rep), elements that are twins are one of that weight: whoever holds one
    of them holds all, since the same edges make their sets. A hub's set then has a row per
    kind of neighbour and not per neighbour.
    """
    if twins is None:
        kept = sets.withColumn("weight", F.lit(1).cast("bigint"))
    else:
        kept = sets.join(twins.groupBy(F.col("rep").alias("nbr")).agg(F.count("id").alias("weight")), "nbr")
    kept = kept.join(sizes, "id")
    freq = kept.groupBy("side", "nbr").agg(F.count(F.lit(1)).alias("freq"))
    return kept.join(freq, ["side", "nbr"])


def _weight(side: int):
    return F.sum(F.when(F.col("side") == side, F.col("weight")).otherwise(0))


def _shared(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, cand, n_out, n_in, c_out, c_in, both_out, both_in) of the pairs (id, cand)."""
    own = tokens.select("id", "side", "nbr", "weight", "n_out", "n_in")
    other = tokens.select(
        F.col("id").alias("cand"),
        "side",
        "nbr",
        F.col("n_out").alias("c_out"),
        F.col("n_in").alias("c_in"),
    )
    return (
        pairs.join(own, "id")
        .join(other, ["cand", "side", "nbr"])
        .groupBy("id", "cand", "n_out", "n_in", "c_out", "c_in")
        .agg(
            _weight(0).alias("both_out"),
            _weight(1).alias("both_in"),
        )
    )


def containment_pairs(candidates: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, cand) left to be compared, (id) covered without a comparison).

    The asked sets form a prefix tree over their elements, rarest first, that is built level
    by level. The larger sets which hold every element on the way to a node come with it,
    once for all sets asked there. A node to which few come is compared; from the others the
    asked sets go on to their next element, and one without a next element is covered by
    whoever came that far. Nodes to which nobody comes end their sets' search. A node is
    named by the least id that passes it, so names of one level differ.
    """
    size = F.col("n_out") + F.col("n_in")
    held = tokens.select(F.col("id").alias("cand"), "side", "nbr", size.alias("cover_size"))
    larger = F.col("cover_size") > F.col("size")
    own = tokens.join(candidates, "id", "left_semi").select("id", size.alias("size"), "side", "nbr", "weight", "freq")
    # After so many steps nothing of a set is left.
    steps = F.when(F.sum("weight") == F.col("size"), F.count(F.lit(1))).otherwise(-1).alias("steps")
    rarest = save(
        own.groupBy("id", "size")
        .agg(F.min(F.struct("freq", "side", "nbr")).alias("t"), steps)
        .select("id", "size", "steps", "t.freq", "t.side", "t.nbr"),
        "rarest",
    )
    few = F.col("freq") <= _NODE
    pairs = rarest.where(few).join(held, ["side", "nbr"]).where(larger).select("id", "cand")
    covered = candidates.select("id").where(F.lit(False))
    asked = rarest.where(~few).select("id", "size", "steps", F.lit(0).cast("bigint").alias("node"))
    if asked.isEmpty():
        return pairs, covered
    order = Window.partitionBy("id").orderBy("freq", "side", "nbr")
    path = save(
        own.join(asked.select("id"), "id", "left_semi")
        .select("id", "side", "nbr", F.row_number().over(order).alias("rn"))
        .where(F.col("rn") <= _DEPTH),
        "containment-path",
    )
    comers = None
    for level in range(1, _DEPTH + 1):
        here = path.where(F.col("rn") == level).select("id", "side", "nbr")
        step = asked.join(here, "id")
        nodes = step.groupBy("node", "side", "nbr").agg(F.min("id").alias("child"), F.min("size").alias("least"))
        if comers is None:
            came = held.join(nodes, ["side", "nbr"])
        else:
            came = comers.join(held.drop("cover_size"), "cand").join(nodes, ["node", "side", "nbr"])
        comers = save(
            came.where(F.col("cover_size") > F.col("least")).select(F.col("child").alias("node"), "cand", "cover_size"),
            "containment-comers",
        )
        counts = comers.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("cover_size").alias("largest"))
        asked = save(
            step.join(nodes, ["node", "side", "nbr"])
            .select("id", "size", "steps", F.col("child").alias("node"))
            .join(counts, "node")
            .where(F.col("largest") > F.col("size")),
            "containment-asked",
        )
        ended = F.col("steps") == level
        covered = covered.unionByName(asked.where(ended).select("id"))
        enough = ~ended if level == _DEPTH else ~ended & (F.col("n") <= _NODE)
        pairs = pairs.unionByName(asked.where(enough).join(comers, "node").where(larger).select("id", "cand"))
        asked = asked.where(~ended & ~enough).select("id", "size", "steps", "node")
        if asked.isEmpty():
            break
    return pairs, covered


def covered_sets(candidates: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id): the candidates whose sets lie inside another vertex's sets on both sides.

    This is the pruning of a neighbourhood's list to its maximal entries: a set that
    covers another one holds the common neighbour too, so it is in the same list, and the
    result is the same for every neighbourhood. The sets are pairwise different, so a cover
    is larger. Who can be one is narrowed down by :func:`containment_pairs` and then compared
    element by element.
    """
    pairs, covered = containment_pairs(candidates, tokens)
    inside = (F.col("both_out") == F.col("n_out")) & (F.col("both_in") == F.col("n_in"))
    return _shared(pairs, tokens).where(inside).select("id").unionByName(covered).distinct()


def _size_class(size):
    """Classes of similar set size; ``_class_floor`` gives the least size of a class."""
    log = F.floor(F.log(size / F.lit(float(_EXACT_SIZES))) / F.log(F.lit(_SIZE_RATIO)) + F.lit(1e-9))
    return F.when(size <= _EXACT_SIZES, size).otherwise(_EXACT_SIZES + 1 + log).cast("int")


def _class_floor(cls):
    # A little low, so that rounding never lifts it above a size of the class.
    low = F.floor(
        F.lit(_EXACT_SIZES * 0.999999) * F.pow(F.lit(_SIZE_RATIO), cls - (_EXACT_SIZES + 1))
    )
    return F.when(cls <= _EXACT_SIZES, cls).otherwise(F.greatest(low, F.lit(_EXACT_SIZES))).cast("bigint")


def _prefix_postings(tokens: DataFrame, threshold: float) -> DataFrame:
    """(channel, nbr, own, other, id, minus_size): the elements a set is looked up under.

    Two sets of Jaccard similarity ``threshold`` that are ordered by rarity share an
    element within their first ``size - overlap + 1``, where ``overlap`` is what their
    sizes demand. The prefix is cut per class of partner sizes (``other``), which keeps
    frequent elements out of it. Elements are ordered by a bucket of similar frequency, a
    whole bucket at a time, so a set of any size is cut without sorting it in one task;
    the prefix can only come out longer than needed.

    ``tokens``: (channel, id, nbr, weight, size, bucket, minus_size).
    """
    # At most a few thousand buckets per set, however large the set is.
    upto = Window.partitionBy("channel", "id").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = (
        tokens.groupBy("channel", "id", "bucket")
        .agg(F.sum("weight").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        .select("channel", "id", "bucket", "before")
    )
    size = F.col("size")
    if threshold > 0:
        # The margins only widen the range of partner sizes and lengthen the prefix.
        least = F.ceil(size * F.lit(threshold) - F.lit(1e-6))
        most = F.floor(size / F.lit(threshold) + F.lit(1e-6))
        partners = F.sequence(_size_class(least), _size_class(most))
        own = _size_class(size)
    else:
        least = F.lit(1)
        partners = F.array(F.lit(0))
        own = F.lit(0)
    partner = F.greatest(_class_floor(F.col("other")), least)
    overlap = F.greatest(
        F.ceil(F.lit(threshold / (1 + threshold)) * (size + partner) - F.lit(1e-6)), F.lit(1)
    )
    return (
        tokens.join(before, ["channel", "id", "bucket"])
        .withColumn("other", F.explode(partners))
        .where(F.col("before") < size - overlap + 1)
        .select("channel", "nbr", own.alias("own"), "other", "id", "minus_size")
    )


def _postings(tokens: DataFrame, threshold: float, symmetric: bool) -> DataFrame:
    """Postings that every pair of two-sided similarity ``threshold`` shares.

    One of the two sides reaches half the threshold. Where both vertices lack a side, that
    side counts 1 and the other one must bring the rest.
    """
    slot = F.pmod(F.xxhash64("nbr"), F.lit(_SLOTS)).cast("int")
    bucket = F.floor(F.log2(F.col("freq").cast("double"))).cast("int") * _SLOTS + slot
    size = F.when(F.col("side") == 0, F.col("n_out")).otherwise(F.col("n_in"))
    minus_size = -(F.col("n_out") + F.col("n_in"))

    def channel(first: int) -> list:
        return [
            (F.col("side") + first).alias("channel"),
            "id",
            "nbr",
            "weight",
            size.alias("size"),
            bucket.alias("bucket"),
            minus_size.alias("minus_size"),
        ]

    postings = _prefix_postings(tokens.select(*channel(0)), threshold / 2)
    if symmetric:
        return postings
    lone = tokens.where("n_out = 0 OR n_in = 0").select(*channel(2))
    return postings.unionByName(_prefix_postings(lone, max(threshold - 1.0, 0.0)))


def _similar(
    pairs: DataFrame, tokens: DataFrame, threshold: float, mode: str, symmetric: bool
) -> DataFrame:
    """(id, minus_size, cand) of the pairs whose two-sided similarity reaches ``threshold``."""

    def side(own: str, other: str, both: str):
        union = F.col(own) + F.col(other) - F.col(both)
        return F.when(union == 0, F.lit(1.0)).otherwise(
            F.try_divide(F.col(both).cast("double"), union.cast("double"))
        )

    out = side("n_out", "c_out", "both_out")
    total = out * 2 if symmetric else out + side("n_in", "c_in", "both_in")
    good = total >= threshold
    if mode == "subset":
        good = good & (F.col("both_out") == F.col("n_out")) & (F.col("both_in") == F.col("n_in"))
    return (
        _shared(pairs, tokens)
        .where(good)
        .select("id", (-(F.col("c_out") + F.col("c_in"))).alias("minus_size"), "cand")
    )


def best_similar(
    tokens: DataFrame, threshold: float, mode: str, symmetric: bool, known: DataFrame | None = None
) -> DataFrame:
    """(id, minus_size, cand): of the uncovered sets similar to a vertex's, the largest, the least id
    among equals.

    Candidates of a posting are tried in that order, a block at a time. A vertex is done
    when every candidate still untried ranks after its best one, so a large group of near
    copies costs one block and not all its pairs; blocks grow, so few rounds cover a
    posting without matches. The head of a posting is found with a row number below a
    limit, which Spark applies before the shuffle: no task sees a whole hot posting.

    ``known`` are the results of a higher threshold: similar at this one too, so they bound
    the search from its first round on.
    """
    postings = save(_postings(tokens, threshold, symmetric), "postings")
    key = ["channel", "nbr", "own", "other"]
    # A candidate's own class is the partner class of whoever looks for it.
    offers = postings.select(
        "channel",
        "nbr",
        F.col("other").alias("own"),
        F.col("own").alias("other"),
        "minus_size",
        F.col("id").alias("cand"),
    )
    probes = postings.drop("minus_size")
    best = known
    block = _FIRST_BLOCK
    while True:
        order = Window.partitionBy(*key).orderBy("minus_size", "cand")
        head = save(
            offers.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= block), "head"
        )
        pairs = probes.join(head, key).where("id <> cand").select("id", "cand").distinct()
        similar = save(_similar(pairs, tokens, threshold, mode, symmetric), "similar")
        asked = similar.select(F.col("cand").alias("id")).distinct()
        covered = covered_sets(asked, tokens).select(F.col("id").alias("cand"))
        found = similar.join(covered, "cand", "left_anti").select("id", "minus_size", "cand")
        if best is not None:
            found = found.unionByName(best)
        best = save(
            found.groupBy("id")
            .agg(F.min(F.struct("minus_size", "cand")).alias("b"))
            .select("id", "b.minus_size", "b.cand"),
            "best",
        )
        full = head.where(F.col("rn") == block).select(
            *key, F.struct("minus_size", "cand").alias("last")
        )
        open_probes = probes.join(full, key)
        bound = open_probes.groupBy("id").agg(F.min("last").alias("last"))
        unresolved = (
            bound.join(best, "id", "left")
            .where(F.col("cand").isNull() | (F.struct("minus_size", "cand") > F.col("last")))
            .select("id")
        )
        probes, left = save_counted(open_probes.join(unresolved, "id", "left_semi"), "probes")
        if left == 0:
            return best
        still = probes.select(*key, "last").distinct()
        offers = save(
            offers.join(still, key)
            .where(F.struct("minus_size", "cand") > F.col("last"))
            .drop("last"),
            "offers",
        )
        probes = probes.drop("last")
        block = min(block * _BLOCK_GROWTH, _LAST_BLOCK)


@dataclass
class _Compared:
    """A graph's distinct neighbour sets, ready to be compared at several thresholds."""

    vertices: DataFrame
    twins: DataFrame
    tokens: DataFrame
    mode: str
    symmetric: bool

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None, mode: str, symmetric: bool) -> _Compared:
        if mode not in ("plain", "subset"):
            raise ValueError(f"unknown mode {mode!r}")
        if symmetric:
            edges = graph.symmetrize(edges)
        edges = save(graph.distinct_edges(edges), "edges")
        vertices = graph.endpoints(edges) if vertices is None else vertices
        all_sets = _sets(edges, symmetric)
        twins = twin_representatives(all_sets)
        # Twins have equal sets, so one vertex per distinct set stands for all of them.
        sizes = twins.where("id = rep").select("id", "n_out", "n_in")
        return cls(vertices, twins, save(_tokens(all_sets, sizes, twins), "tokens"), mode, symmetric)

    def best(self, threshold: float, known: DataFrame | None = None) -> DataFrame:
        if not 1.0 <= threshold <= 2.0:
            raise ValueError("threshold must lie between 1 and 2")
        return best_similar(self.tokens, threshold, self.mode, self.symmetric, known)

    def choices(self, best: DataFrame) -> DataFrame:
        """(id, cand): whom each vertex joins, null for nobody."""
        ranked = best.select(F.col("id").alias("rep"), "minus_size", "cand")
        # For a twin the representative itself is a candidate too, of the twin's own size.
        own = F.struct((-(F.col("n_out") + F.col("n_in"))).alias("s"), F.col("rep").alias("c"))
        other = F.struct(F.col("minus_size").alias("s"), F.col("cand").alias("c"))
        prefers_rep = (F.col("id") != F.col("rep")) & (F.col("cand").isNull() | (own < other))
        rows = save(
            self.twins.join(ranked, "rep", "left").select(
                "id", "rep", "cand", prefers_rep.alias("prefers_rep")
            ),
            "choices",
        )
        asked = rows.where("prefers_rep").select(F.col("rep").alias("id")).distinct()
        covered = covered_sets(asked, self.tokens).select(
            F.col("id").alias("rep"), F.lit(True).alias("covered")
        )
        takes_rep = F.col("prefers_rep") & F.col("covered").isNull()
        return rows.join(covered, "rep", "left").select(
            "id", F.when(takes_rep, F.col("rep")).otherwise(F.col("cand")).alias("cand")
        )


def structural_fuzzy(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    threshold: float = 1.0,
    mode: str = "plain",
    levels: int = 2,
    symmetric: bool = True,
) -> DataFrame:
    """A vertex joins the largest similar vertex among the maximal ones that share a
    neighbour with it; without one it stays its own cluster.

    Similar means a two-sided Jaccard of at least ``threshold`` (1 to 2). ``symmetric``
    (the default) adds every edge's reverse first. Among equally large candidates the
    least id wins. One pass: nobody follows the choice of its own choice.
    """
    compared = _Compared.of(edges, vertices, mode, symmetric)
    joined = compared.choices(compared.best(threshold))
    own = F.array_repeat(F.col("id"), levels - 1)
    keys = compared.vertices.select("id").join(joined, "id", "left").select(
        "id", F.concat(F.array(F.coalesce("cand", "id")), own).alias("key")
    )
    return with_key_columns(keys, levels)


def falling_thresholds(last: float, steps: int) -> list[float]:
    """From 2 down to ``last`` in equal steps."""
    return [2.0 - k * (2.0 - last) / steps for k in range(steps + 1)] if last < 2.0 else [2.0]


def structural_fuzzy_schedule(
    edges: DataFrame,
    vertices: DataFrame | None = None,
    thresholds: Sequence[float] = (2.0, 1.8, 1.6, 1.4, 1.2, 1.0),
    mode: str = "plain",
    levels: int = 2,
    symmetric: bool = True,
) -> DataFrame:
    """:func:`structural_fuzzy` at falling thresholds, the keys carried from pass to pass.

    Every vertex starts with its own id on all levels. In a pass each vertex that has a
    choice at the pass's threshold takes over the start of the chosen vertex's key, as many
    levels as that key distinguishes (``key_merge``), as the key was after the pass
    before; so a vertex that joined a cluster brings later followers to that cluster. All
    vertices of a pass choose at once. What was similar at a higher threshold still is, so a
    pass starts from the choices of the one before and looks only for larger ones.
    """
    if any(a <= b for a, b in zip(thresholds, thresholds[1:])):
        raise ValueError("thresholds must fall")
    compared = _Compared.of(edges, vertices, mode, symmetric)
    keys = compared.vertices.select("id", F.array_repeat("id", levels).alias("key"))
    best = None
    for threshold in thresholds:
        best = compared.best(threshold, best)
        choices = compared.choices(best).where("cand IS NOT NULL")
        chosen = keys.select(F.col("id").alias("cand"), F.col("key").alias("chosen"))
        taken = choices.join(chosen, "cand").select("id", "chosen")
        key = F.when(F.col("chosen").isNull(), F.col("key")).otherwise(key_merge(F.col("chosen"), F.col("key")))
        keys = save(keys.join(taken, "id", "left").select("id", key.alias("key")), "keys")
    return with_key_columns(keys, levels)
