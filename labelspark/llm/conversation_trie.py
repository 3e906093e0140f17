"""The prefix trie of conversations, as ROLLUPs over columns of turn ids.

A turn's id is a digest of role and text with the text's length behind it. Conversations with the
same sequence of ids are one class with a number of members, so a conversation that a third of
all share is one row. The first ``BLOCK`` turns of every class stand in columns, and one
``GROUP BY key, ROLLUP (t1, ..., tB)`` aggregates all their prefixes together; ``grouping_id``
tells a prefix's length. Classes with more turns go on in a further block, keyed by the node that
they reached in the block before. A class that is alone at the end of a block has a tail without
branches, which is written out directly; so there are as many blocks as turns that different
conversations share, not as the longest conversation has.

Sums over subtrees are the same ROLLUP over the nodes, from the last block to the first: a
block's total per key is added to the node it hangs from.

A node is known by its depth and the smallest conv_id of its members. Member lists are hashed in
order without being collected: members are ranged over the cluster by (class, conv_id), each
range is written as short texts, and only these are put through SHA-256 one after another.

Defined cases: a null role or text is empty; a null turn comes first, and turns with one number
are ordered by their ids; repeated rows are turns of their own; rows without a conv_id belong to
no conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.session import materialize

BLOCK = 8
# Bytes of a turn's id: a digest, and the number of code points of its text.
DIGEST_BYTES, ID_BYTES = 16, 20
# Ids in one piece of a member list.
PIECE_IDS = 20_000

NODES = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)
SCHEMA = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, end_class long"
)


def _hexed(digest: Column) -> Column:
    return F.unhex(F.substring(digest, 1, 2 * DIGEST_BYTES))


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path): every conversation's turn ids in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    size = F.unhex(F.lpad(F.hex(F.length(text)), 8, "0"))
    entry = F.struct(
        F.col("turn").isNotNull().alias("has"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.concat(_hexed(F.sha2(said, 256)), size).alias("id"),
    )
    return (
        turns.filter("conv_id IS NOT NULL")
        .select(F.col("conv_id").cast("long"), entry.alias("entry"))
        .groupBy("conv_id").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        .select("conv_id", F.col("entries.id").alias("path"))
    )


def branched(own: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """(conv_id, path): the first turns of the conversation that opens each ``every`` ids, then
    what each conversation has after as many; how many (0 to ``most``) follows from its id."""
    own = materialize(own, "conversations")
    lead = F.col("conv_id") - F.col("conv_id") % every
    heads = own.filter(F.col("conv_id") == lead).select(
        F.col("conv_id").alias("lead"), F.slice("path", 1, most).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    rest = F.slice("path", h + 1, F.greatest(F.size("path") - h, F.lit(0)))
    none = F.array().cast("array<binary>")
    return (
        own.withColumn("lead", lead).join(heads, "lead", "left")
        .select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), h), none), rest).alias("path"))
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Member lists of sorted rows (seq, conv_id), in pieces (seq, low, said)."""
    seq, ids = None, []

    def piece():
        return pa.RecordBatch.from_arrays(
            [pa.array([seq], pa.binary()), pa.array([ids[0]], pa.int64()),
             pa.array([",".join(map(str, ids))], pa.string())],
            names=["seq", "low", "said"],
        )

    for batch in batches:
        for own, conv_id in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (own != seq or len(ids) >= PIECE_IDS):
                yield piece()
                ids = []
            seq = own
            ids.append(conv_id)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each seq, joined by commas; rows are sorted by (seq, low)."""
    seq, state, done = None, None, []

    def flushed():
        return pa.RecordBatch.from_arrays(
            [pa.array([s for s, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())],
            names=["seq", "ends_sha256"],
        )

    for batch in batches:
        for own, said in zip(batch.column("seq").to_pylist(), batch.column("said").to_pylist()):
            if own == seq:
                state.update(b",")
            else:
                if state is not None:
                    done.append((seq, state.hexdigest()))
                seq, state = own, hashlib.sha256()
            state.update(said.encode())
        yield flushed()
        done = []
    if state is not None:
        done.append((seq, state.hexdigest()))
        yield flushed()


def classes(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, size, path, ends_sha256): conversations with equal paths, under their
    smallest conv_id."""
    spark = conversations.sparkSession
    whole = F.array_join(F.transform("path", lambda t: F.hex(t)), "")
    named = materialize(
        conversations.select("conv_id", "path", _hexed(F.sha2(whole, 256)).alias("seq")),
        "rebuilt-conversations",
    )
    members = named.select("seq", "conv_id")
    ranged = members.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "seq binary, low long, said string")
    # The pieces of one class are its number of members over PIECE_IDS, and one per range.
    ends = (
        pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq")
        .sortWithinPartitions("seq", "low").mapInArrow(_hashed, "seq binary, ends_sha256 string")
    )
    sizes = members.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    firsts = sizes.join(ends, "seq").select("conv_id", "n", "ends_sha256")
    found = named.select("conv_id", "path").join(firsts, "conv_id")
    return materialize(
        found.select("conv_id", "n", F.size("path").alias("size"), "path", "ends_sha256"),
        "conversation-classes",
    )


def _rollup(rows: DataFrame, *aggregates: str) -> DataFrame:
    """``aggregates`` over all prefixes of t1..tB per key, with ``prefix``, its length;
    prefixes that reach beyond a row's last id are left out."""
    names = [f"t{i}" for i in range(1, BLOCK + 1)]
    columns = ", ".join(names)
    found = rows.sparkSession.sql(
        f"""SELECT key, {columns}, {BLOCK} - bit_count(grouping_id()) AS prefix, {", ".join(aggregates)}
            FROM {{rows}} GROUP BY key, ROLLUP ({columns})""",
        rows=rows,
    )
    last = F.element_at(F.array(*names), F.greatest("prefix", F.lit(1)))
    return found.withColumn("last", last).filter("prefix = 0 OR last IS NOT NULL")


def _laid(ids: list[Column]) -> Column:
    """The ids of a node inside its block, end to end."""
    return F.concat(*[F.coalesce(i, F.lit(b"")) for i in ids])


def _chars(turn_id: Column) -> Column:
    return F.conv(F.hex(F.substring(turn_id, DIGEST_BYTES + 1, 4)), 16, 10).cast("long")


def _block(state: DataFrame, off: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, state of the next block) of the classes ``state`` (key, conv_id, n, size, path)."""
    names = [f"t{i}" for i in range(1, BLOCK + 1)]
    laid = state.select(
        "key", "conv_id", "n", (F.col("size") - off).alias("left"),
        *[F.get("path", F.lit(off + i)).alias(t) for i, t in enumerate(names)],
    )
    rolled = _rollup(
        laid, "min(conv_id) AS conv_id", "sum(n) AS n_convs", "count(*) AS n_classes",
        *[f"min(CASE WHEN left = {i} THEN conv_id END) AS e{i}" for i in range(1, BLOCK + 1)],
    )
    ends = F.array(*[f"e{i}" for i in range(1, BLOCK + 1)])
    own = materialize(
        rolled.filter("prefix > 0").select(
            "key", F.col("prefix").alias("d"), _laid([F.col(t) for t in names]).alias("node"), "conv_id", "n_convs",
            "n_classes", F.element_at(ends, F.col("prefix")).alias("end_class"), _chars(F.col("last")).alias("chars"),
        ),
        "prefixes",
    )
    above = own.select("key", F.col("node").alias("up"), F.col("conv_id").alias("above"))
    up = F.expr(f"substring(node, 1, {ID_BYTES} * (d - 1))")
    nodes = materialize(
        own.withColumn("up", up).join(above, ["key", "up"], "left")
        .select(
            "key", "d", "node", "conv_id", "n_convs", "end_class", "chars",
            F.when(F.col("d") == 1, F.col("key")).otherwise(F.col("above")).alias("parent_conv_id"),
        ),
        "trie-nodes",
    )
    reached = own.filter(f"d = {BLOCK}").select(
        "key", "node", F.col("conv_id").alias("next"), "n_classes"
    )
    more = (
        state.filter(F.col("size") > off + BLOCK)
        .withColumn("node", _laid([F.get("path", F.lit(off + i)) for i in range(BLOCK)]))
        .join(reached, ["key", "node"])
        .select(F.col("next").alias("key"), "conv_id", "n", "size", "path", "n_classes")
    )
    return nodes, materialize(more, "longer-conversations")


def _tails(alone: DataFrame, off: int) -> DataFrame:
    """Nodes beyond depth ``off`` of classes that nothing else shares; one chain per class."""
    turns = alone.select(
        "conv_id", "n", "size", "key",
        F.posexplode(F.slice("path", off + 1, F.col("size") - off)).alias("at", "id"),
    )
    saved = (F.col("n") - 1) * _chars(F.col("id"))
    depth = F.col("at") + off + 1
    # A conversation's own turns, from its end: as long as one conversation.
    onward = F.sum(saved).over(
        Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    )
    return turns.select(
        "conv_id", depth.cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(depth < F.col("size"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), onward.alias("saved_tokens"),
        F.when(depth == F.col("size"), F.col("conv_id")).alias("end_class"),
    )


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node (see ``NODES``) of the trie over ``conversations`` (conv_id, path)."""
    found = classes(conversations)
    facts = found.agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("size").alias("longest")
    )
    facts = facts.first()
    if facts["n_convs"] is None:
        return _result(found.sparkSession.createDataFrame([], SCHEMA), found)
    state = found.filter("size > 0").select(
        F.lit(facts["conv_id"]).cast("long").alias("key"), "conv_id", "n", "size", "path"
    )
    blocks, tails, off = [], [], 0
    while facts["longest"] > off and not (blocks and state.isEmpty()):
        nodes, more = _block(state, off)
        blocks.append((off, nodes))
        off += BLOCK
        alone = more.filter("n_classes = 1")
        if not alone.isEmpty():
            tails.append((off, materialize(_tails(alone, off), "trie-tails")))
        state = more.filter("n_classes > 1").drop("n_classes")

    hung = {at: tail.filter(F.col("depth") == at + 1) for at, tail in tails}
    parts = [tail for _, tail in tails]
    carry = None
    for off, nodes in reversed(blocks):
        below = [] if carry is None else [carry]
        if off + BLOCK in hung:
            below.append(
                hung[off + BLOCK].select(
                    F.col("parent_conv_id").alias("key"), F.lit(1).cast("long").alias("children"),
                    F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"),
                )
            )
        done, carry = _summed(nodes, off, below)
        parts.append(done)
    root = {"children": 0, "leaves": 1, "saved": 0}
    if carry is not None:
        root = carry.first().asDict()
    ends = found.filter("size = 0").agg(F.first("conv_id").alias("end_class")).first()
    top = found.sparkSession.createDataFrame(
        [(facts["conv_id"], 0, None, facts["n_convs"], root["children"], root["leaves"],
          root["saved"], ends["end_class"])],
        SCHEMA,
    )
    for part in parts:
        top = top.unionByName(part)
    return _result(top, found)


def _summed(nodes: DataFrame, off: int, below: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(finished nodes of a block, sums per key for the block before); ``below``: sums per node
    at the block's last depth of what hangs from it."""
    own = nodes
    added = {n: F.lit(0).cast("long") for n in ("children", "leaves", "saved")}
    if below:
        hanging = below[0]
        for more in below[1:]:
            hanging = hanging.unionByName(more)
        hanging = hanging.select(F.col("key").alias("conv_id"), F.lit(BLOCK).alias("d"), *added)
        own = nodes.join(hanging, ["conv_id", "d"], "left")
        added = {n: F.coalesce(n, F.lit(0)) for n in added}
    inside = nodes.filter("d > 1").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("d") - 1).alias("d")
    ).agg(F.count("*").alias("inside"))
    own = own.join(inside, ["conv_id", "d"], "left").withColumn(
        "n_children", F.coalesce("inside", F.lit(0)) + added["children"]
    )
    own = own.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(added["leaves"]))
    own = own.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars") + added["saved"])
    cuts = [
        F.when(
            F.col("d") >= i, F.substring("node", ID_BYTES * (i - 1) + 1, ID_BYTES)
        ).alias(f"t{i}")
        for i in range(1, BLOCK + 1)
    ]
    own = materialize(
        own.select("key", "d", "conv_id", "parent_conv_id", "n_convs", "n_children", "end_class",
                   "n_leaves", "saved", *cuts),
        "trie-block",
    )
    sums = materialize(
        _rollup(
            own, "min(conv_id) AS conv_id", "sum(n_leaves) AS leaves", "sum(saved) AS saved",
            "count_if(d = 1) AS children",
        ).select("key", F.col("prefix").alias("d"), "conv_id", "leaves", "saved", "children"),
        "trie-sums",
    )
    carry = sums.filter("d = 0").select("key", "children", "leaves", "saved")
    done = own.drop("n_leaves", "saved", "key").join(
        sums.filter("d > 0").select("conv_id", "d", "leaves", "saved"), ["conv_id", "d"]
    )
    return (
        done.select(
            "conv_id", (F.col("d") + off).cast("long").alias("depth"), "parent_conv_id", "n_convs",
            "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            "end_class",
        ),
        carry,
    )


def _result(nodes: DataFrame, found: DataFrame) -> DataFrame:
    ends = found.select(F.col("conv_id").alias("end_class"), "ends_sha256")
    nothing = F.sha2(F.lit(""), 256)
    return nodes.join(ends, "end_class", "left").select(
        *[F.coalesce(c, nothing).alias(c) if c == "ends_sha256" else c for c in NODES]
    )
