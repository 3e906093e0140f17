"""Exact dedup by deterministic block naming; DataFrame functions only.

A text without its white space is cut into blocks of a fixed size. Distinct blocks are sorted
and numbered: the number is the block's name, so equal names mean equal blocks, without any
chance of a collision. Adjacent names are then paired and the distinct pairs numbered in turn,
until each document has one name; with the number of its blocks, that is its identity.

Skew: a block, pair or identity may be held by a third of all rows. Blocks are first combined
inside each input partition, so the shuffle that names them sees a hot block once per input
partition, and only its text and one row number travel there; the owners follow by that number.
Pairs and identities are joined to written tables of distinct names, where adaptive execution
splits the hot side.

Defined cases: null text counts as empty; empty texts are equal to each other; rows with the
same doc_id are rows of their own; of rows equal in length and doc_id any one stays; a null
doc_id comes after all others; an empty table gives an empty result; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.session import materialize

# Code points in a block. Documents of one block need no second round.
BLOCK = 4096

# Fixed value: characters that do not count.
WHITE = r"[\x20\x09-\x0D]+"


def blocks(docs: DataFrame, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_chars, sha, n_blocks, part, pos, block): one row per block.

    ``row`` names a column of distinct longs, if ``docs`` has one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.spark_partition_id().alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("n_chars"),
        F.regexp_replace(text, WHITE, "").alias("plain"),
    )
    cut = F.regexp_extract_all(F.col("plain"), F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    found = F.when(F.col("plain") == "", F.array(F.lit(""))).otherwise(cut)
    return (
        rows.withColumn("sha", F.unhex(F.sha2("plain", 256)))
        .withColumn("blocks", found)
        .withColumn("n_blocks", F.size("blocks"))
        .select("row", "doc_id", "n_chars", "sha", "n_blocks", "part",
                F.posexplode("blocks").alias("pos", "block"))
    )


def block_names(found: DataFrame) -> DataFrame:
    """(row, doc_id, n_chars, sha, n_blocks, pos, name), the block's name in place of its text."""
    owner = F.struct("row", "pos", "doc_id", "n_chars", "sha", "n_blocks")
    groups = (
        found.groupBy("block", "part").agg(F.collect_list(owner).alias("owners"))
        .withColumn("first", F.array_min("owners"))
    )
    names = (
        groups.select("block", F.struct("first.row", "first.pos").alias("at"))
        .groupBy("block").agg(F.collect_list("at").alias("places"))
        .sortWithinPartitions("block")
        # Numbered before the places are listed: all places of a block get its one name.
        .withColumn("name", F.monotonically_increasing_id())
        .select("name", F.explode("places").alias("at"))
    )
    return (
        groups.select(F.struct("first.row", "first.pos").alias("at"), "owners")
        .join(names, "at")
        .select("name", F.explode("owners").alias("o"))
        .select("o.*", "name")
    )


def pair_names(named: DataFrame) -> DataFrame:
    """(row, n, pos, name) of the next round: adjacent names become one."""
    even = F.col("pos") % 2 == 0
    pairs = named.groupBy("row", "n", F.expr("pos div 2").cast("int").alias("half")).agg(
        F.max(F.when(even, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1).cast("long")).alias("b"),
    )
    names = materialize(
        pairs.select("a", "b").distinct().sortWithinPartitions("a", "b")
        .withColumn("name", F.monotonically_increasing_id()),
        "pair-names",
    )
    return pairs.join(names, ["a", "b"]).select(
        "row", F.expr("(n + 1) div 2").cast("int").alias("n"), F.col("half").alias("pos"), "name"
    )


def identities(docs: DataFrame, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """(row, doc_id, n_chars, sha, n_blocks, name): equal (n_blocks, name), equal texts."""
    named = materialize(block_names(blocks(docs, block, row)), "block-names")
    whole = ("row", "doc_id", "n_chars", "sha", "n_blocks")
    single = named.filter("n_blocks = 1").select(*whole, "name")
    longest = named.agg(F.max("n_blocks")).first()[0] or 1
    if longest == 1:
        return single
    left = named.filter("n_blocks > 1").select("row", F.col("n_blocks").alias("n"), "pos", "name")
    done = []
    while longest > 1:
        left = materialize(pair_names(left), "paired")
        done.append(left.filter("n = 1").select("row", "name"))
        left, longest = left.filter("n > 1"), (longest + 1) // 2
    # Rounds number anew, but equal numbers of blocks end in the same round.
    finished = done[0]
    for more in done[1:]:
        finished = finished.unionByName(more)
    long_rows = named.filter("n_blocks > 1 AND pos = 0").select(*whole).join(finished, "row")
    return single.unionByName(long_rows.select(*whole, "name"))


def exact_dedup(docs: DataFrame, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """(row, doc_id, keep_id, keep_row, group_size, kept, text_sha256), a row per input row.

    Of equal texts the row with most code points stays, then that with the smallest doc_id.
    """
    known = materialize(identities(docs, block, row), "identities")
    best = F.struct(
        (-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"
    )
    groups = materialize(
        known.groupBy("n_blocks", "name")
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("n_blocks", "name", "group_size", F.col("best.doc_id").alias("keep_id"),
                F.col("best.row").alias("keep_row")),
        "identity-groups",
    )
    return known.join(groups, ["n_blocks", "name"]).select(
        "row", "doc_id", "keep_id", "keep_row", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
