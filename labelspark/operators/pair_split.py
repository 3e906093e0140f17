"""Stratified split that keeps the shares of label pairs, not only of whole label sets.

Rows with equal label sets are interchangeable, so what has to be decided is how many rows of each
set go to validation. Of ``n`` rows, the whole part of ``n * t`` goes there at once; what is left
of a set is one row that may or may not go. These open rows are served pair by pair (a label with
itself counts as a pair), the rarest first: a pair still lacks so many validation rows, and takes
them from its open sets, those first whose pairs together lack most.

Serving one pair after the other would take as many rounds as there are pairs. In a round all
pairs are served that are the rarest one in each of their open sets: no two of them share a set,
so they cannot disturb each other. What comes last may be left with what others did not want, so
afterwards sets give and take single rows, alone or one for another, as long as that lowers the sum
of the pairs' squared deviations; again in rounds of moves that touch no common pair. Sets and what
each pair lacks are tables between rounds, so neither sets nor pairs are collected.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.checks import require
from labelspark.operators.split import BUCKET_DIGITS
from labelspark.session import materialize


def _rows(instances: DataFrame, seed: int | None) -> DataFrame:
    """(instance_id, set_key, labels, digest, bucket)."""
    labels = F.array_sort(F.array_distinct(F.col("genre_ids").cast("array<bigint>")))
    labels = F.coalesce(F.array_compact(labels), F.array().cast("array<bigint>"))
    salt = "" if seed is None else f"{seed}:"
    id_text = F.coalesce(F.col("instance_id").cast("string"), F.lit(""))
    return instances.select("instance_id", labels.alias("labels")).select(
        "instance_id", "labels", F.array_join(F.col("labels").cast("array<string>"), ",").alias("set_key"),
        F.md5(F.concat(F.lit(salt), id_text)).alias("digest"),
    ).withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))


def set_pairs(sets: DataFrame) -> DataFrame:
    """(set_key, a, b): the pairs a <= b of every set (set_key, labels); an empty set has the
    pair of nulls, so that rows without labels are a stratum too."""
    firsts = sets.select("set_key", "labels", F.explode_outer("labels").alias("a"))
    return firsts.select(
        "set_key", "a",
        F.explode_outer(F.filter("labels", lambda x: x >= F.col("a"))).alias("b"),
    )


def _served(open_pairs: DataFrame, lacking: DataFrame, seed: int) -> DataFrame:
    """(set_key, v): sets decided in a round; ``open_pairs`` holds (set_key, pair), ``lacking``
    (pair, lack)."""
    sizes = open_pairs.groupBy("pair").agg(F.count("*").alias("k"))
    known = open_pairs.join(sizes, "pair").join(lacking, "pair")
    rank = F.struct("k", F.xxhash64("pair", F.lit(seed)).alias("h"), "pair")
    best = known.groupBy("set_key").agg(
        F.min(rank).alias("best"), F.sum("lack").alias("need")
    ).select("set_key", F.col("best.pair").alias("pair"), F.col("best.k").alias("k"), "need")
    won = best.groupBy("pair").agg(F.count("*").alias("won"))
    serving = best.join(won, "pair").filter("won = k").join(lacking, "pair")
    order = Window.partitionBy("pair").orderBy(
        F.desc("need"), F.xxhash64("set_key", F.lit(seed)), "set_key"
    )
    # Whole numbers of thousandths, so that sums and halves are exact.
    return serving.withColumn("at", F.row_number().over(order)).select(
        "set_key", (F.col("at") * 1000 <= F.col("lack") + 500).cast("long").alias("v")
    )


def _moves(sets: DataFrame, all_pairs: DataFrame, lacking: DataFrame, seed: int) -> DataFrame:
    """(set_key, by): rows given to (1) or taken from (-1) sets (set_key, labels, n, whole, v), as
    lowers the squares of what pairs lack.

    Proposed are, per set, the better way alone, and per pair the best set to give to and the best
    one to take from together. Of the proposals those are made that are the best one in all pairs
    they touch.
    """
    sums = all_pairs.join(lacking, "pair").groupBy("set_key").agg(
        F.count("*").alias("m"), F.sum("lack").alias("lack")
    )
    # Square of (lack - 1000) or (lack + 1000), less the square of lack, over all pairs of a set.
    # No set is moved further than to two rows from its share.
    ways = [
        ("up", 1, F.col("m") * 1_000_000 - 2000 * F.col("lack"), "v < 2 AND whole + v < n"),
        ("down", -1, F.col("m") * 1_000_000 + 2000 * F.col("lack"), "v > -1 AND whole + v > 0"),
    ]
    known = sets.join(sums, "set_key")
    offers = [
        known.filter(allowed).select("set_key", "labels", F.lit(by).alias("by"), change.alias("change"))
        for _, by, change, allowed in ways
    ]
    alone = offers[0].unionAll(offers[1]).filter("change < 0").select(
        F.concat(F.lit("set "), "set_key").alias("move"), "set_key", "by", "change"
    )
    best = [
        all_pairs.join(offer, "set_key").groupBy("pair").agg(
            F.min(F.struct("change", F.xxhash64("set_key", F.lit(seed)).alias("h"), "set_key", "labels")).alias(name)
        )
        for (name, *_), offer in zip(ways, offers)
    ]
    both = F.size(F.array_intersect("up.labels", "down.labels"))
    # A pair that is given to by one set and taken from by the other stays as it is.
    change = F.col("up.change") + F.col("down.change") - 1_000_000 * both * (both + 1)
    swaps = (
        best[0].join(best[1], "pair").filter("up.set_key <> down.set_key")
        .withColumn("change", change).filter("change < 0")
        .select(
            F.concat(F.lit("pair "), "pair").alias("move"), "change",
            F.explode(F.array(
                F.struct(F.col("up.set_key").alias("set_key"), F.lit(1).alias("by")),
                F.struct(F.col("down.set_key").alias("set_key"), F.lit(-1).alias("by")),
            )).alias("s"),
        )
    )
    proposed = materialize(
        alone.unionByName(swaps.select("move", "s.set_key", "s.by", "change")), "split-moves"
    )
    rank = F.struct("change", F.xxhash64("move", F.lit(seed)).alias("h"), "move")
    touched = materialize(
        proposed.join(all_pairs, "set_key").select("pair", rank.alias("rank")).distinct(), "split-touched"
    )
    first = touched.groupBy("pair").agg(F.min("rank").alias("first"))
    made = (
        touched.join(first, "pair").groupBy(F.col("rank.move").alias("move"))
        .agg(F.every(F.col("rank") == F.col("first")).alias("made")).filter("made")
    )
    return proposed.join(made, "move", "left_semi").select("set_key", "by")


def _less(lacking: DataFrame, all_pairs: DataFrame, moves: DataFrame) -> DataFrame:
    """``lacking`` after ``moves`` (set_key, by): rows given to (1) or taken from (-1) pairs."""
    taken = all_pairs.join(moves, "set_key").groupBy("pair").agg((1000 * F.sum("by")).alias("taken"))
    return materialize(
        lacking.join(taken, "pair", "left")
        .select("pair", (F.col("lack") - F.coalesce("taken", F.lit(0))).alias("lack")),
        "lacking",
    )


def validation_counts(sets: DataFrame, share: Fraction, seed: int = 0) -> DataFrame:
    """(set_key, v): how many of the ``n`` rows of every set (set_key, labels, n) are validation
    rows. What pairs lack is counted in thousandths of a row."""
    a, b = share.numerator, share.denominator
    whole = F.expr(f"(n * {a}L) div {b}L")
    left = F.expr(f"((n * {a}L) % {b}L * 1000 + {b // 2}L) div {b}L")
    sets = materialize(
        sets.select("set_key", "labels", "n", whole.alias("whole"), left.alias("rest")), "split-sets"
    )
    name = F.concat_ws(":", F.coalesce(F.col("a").cast("string"), F.lit("")), F.col("b").cast("string"))
    all_pairs = materialize(set_pairs(sets).select("set_key", name.alias("pair")), "set-pairs")
    rests = sets.select("set_key", "rest")
    lacking = materialize(
        all_pairs.join(rests, "set_key").groupBy("pair").agg(F.sum("rest").alias("lack")), "lacking"
    )
    open_pairs = materialize(
        all_pairs.join(rests.filter("rest > 0"), "set_key", "left_semi"), "open-pairs"
    )
    decided = sets.select("set_key", F.lit(0).cast("long").alias("v")).limit(0)
    while not open_pairs.isEmpty():
        now = materialize(_served(open_pairs, lacking, seed), "served-sets")
        decided = decided.unionAll(now)
        lacking = _less(lacking, open_pairs, now.select("set_key", F.col("v").alias("by")))
        open_pairs = materialize(open_pairs.join(now, "set_key", "left_anti"), "open-pairs")
    state = materialize(
        sets.drop("rest").join(decided, "set_key", "left").withColumn("v", F.coalesce("v", F.lit(0))),
        "split-state",
    )
    while True:
        moves = materialize(_moves(state, all_pairs, lacking, seed), "made-moves")
        if moves.isEmpty():
            return state.select("set_key", (F.col("whole") + F.col("v")).alias("v"))
        lacking = _less(lacking, all_pairs, moves)
        state = materialize(
            state.join(moves, "set_key", "left")
            .withColumn("v", F.col("v") + F.coalesce("by", F.lit(0))).drop("by"),
            "split-state",
        )


def second_order_split(
    instances: DataFrame, test_size: float = 0.2, seed: int | None = None
) -> DataFrame:
    """(instance_id, set_key, is_validation): each label's and each label pair's share of
    validation rows is kept as near to ``test_size`` as serving the rarest pairs first allows.

    Inside a label set rows are lined up by a digest of their ids, as in ``stratified_split``,
    and the set's validation rows are spread evenly along that line; positions come from counts
    per bucket, so a label set with a third of all rows is ranked by many tasks. Null labels are
    left out; rows without labels are a stratum of their own.
    """
    require("test_size", test_size, "between 0 and 1, without both", 0 < test_size < 1)
    share = Fraction(test_size).limit_denominator(10_000)
    rows = _rows(instances, seed)
    sizes = materialize(rows.groupBy("set_key", "bucket").agg(
        F.count("*").alias("n"), F.first("labels").alias("labels")
    ), "split-buckets")
    sets = sizes.groupBy("set_key").agg(F.sum("n").alias("n"), F.first("labels").alias("labels"))
    counts = validation_counts(sets, share, seed or 0)
    in_set = Window.partitionBy("set_key").orderBy("bucket")
    offsets = (
        sizes.withColumn("offset", F.sum("n").over(in_set) - F.col("n")).select("set_key", "bucket", "offset")
        .join(sets.select("set_key", F.col("n").alias("n_set")), "set_key").join(counts, "set_key")
    )
    inside = Window.partitionBy("set_key", "bucket").orderBy("digest", "instance_id")
    placed = (
        rows.drop("labels").join(offsets, ["set_key", "bucket"])
        .withColumn("p", F.col("offset") + F.row_number().over(inside))
    )
    return placed.select(
        "instance_id", "set_key",
        F.expr("(p * v) div n_set > ((p - 1) * v) div n_set").alias("is_validation"),
    )


def pair_shares(instances: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, n, n_validation): rows that hold each label (a = b) and each pair of labels, and
    how many of them the split ``parts`` (instance_id, is_validation) took for validation."""
    rows = _rows(instances, None).select("instance_id", "set_key", "labels")
    sets = rows.groupBy("set_key").agg(F.first("labels").alias("labels"))
    counted = (
        rows.select("instance_id", "set_key").join(parts.select("instance_id", "is_validation"), "instance_id")
        .groupBy("set_key")
        .agg(F.count("*").alias("n"), F.count_if("is_validation").alias("n_validation"))
    )
    return (
        set_pairs(sets).filter("b IS NOT NULL").join(counted, "set_key")
        .groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("n_validation").alias("n_validation"))
    )
