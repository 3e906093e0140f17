"""Dedup of lines that many documents share.

Each text is cut into lines; a line's key is the line stripped and with A-Z lower-cased. Keys
are hashed, distinct per document, and counted by Spark with partial sums, so a line held by a
third of all documents is one row per task. Keys in enough documents lose their lines
everywhere but in the largest doc_id that holds them. What a document loses is joined back by
its id, and the rest is put together in the order of positions.

Defined cases: null or empty text is one empty line; rows with the same doc_id count as one
document and lose the same lines; a null doc_id counts as a document smaller than any other;
a key repeated inside a document counts once; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import slices
from labelspark.session import materialize

MIN_KEY_CHARS = 40
MIN_DOCUMENTS = 5

# Fixed value: characters stripped from both ends of a line.
STRIPPED = b" \t\n\x0b\x0c\r"

KEPT = "doc_id long, n_lines long, n_dropped long, kept_text binary, dropped array<int>"
DIGESTS = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def _key(line: bytes, min_chars: int) -> bytes | None:
    """16-byte digest of the line's key, or None if the key is too short."""
    if len(line) < min_chars:
        return None
    key = line.strip(STRIPPED).lower()
    if len(key) < min_chars or (
        len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars
    ):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()


def line_keys(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(doc_id, key): the distinct long keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in slices(batches):
            ids, keys = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch)):
                own = {_key(line, min_chars) for line in text.split(b"\n")} - {None}
                ids += [doc_id] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, key binary"
    )


def shared_keys(keys: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(key, last_id): keys of at least ``min_documents`` documents and where they stay."""
    return (
        keys.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_id"))
        .filter(F.col("n") >= min_documents)
        .select("key", "last_id")
    )


def losses(keys: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, lost): per document, the keys it loses."""
    return (
        keys.join(shared, "key")
        .filter(~F.col("doc_id").eqNullSafe(F.col("last_id")))
        .groupBy("doc_id").agg(F.collect_list("key").alias("lost"))
    )


def _drop_lines(batches, min_chars: int, finish, names: list[str], types: list[pa.DataType]):
    for batch in slices(batches):
        rows = []
        ids, lost = batch.column("doc_id").to_pylist(), batch.column("lost").to_pylist()
        for doc_id, text, gone in zip(ids, _texts(batch), lost):
            lines = text.split(b"\n")
            gone = set(gone or ())
            dropped = [i for i, x in enumerate(lines) if gone and _key(x, min_chars) in gone]
            left = set(dropped)
            kept = b"\n".join([x for i, x in enumerate(lines) if i not in left])
            rows.append((doc_id, len(lines), len(dropped), *finish(kept, dropped)))
        columns = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=names
        )


def _with_losses(docs: DataFrame, min_chars: int, min_documents: int) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A document counts once per key, also if its id has several rows.
    keys = materialize(line_keys(own, min_chars).distinct(), "line-keys")
    shared = materialize(shared_keys(keys, min_documents), "shared-lines")
    lost = materialize(losses(keys, shared), "lost-lines")
    # Lists of what is lost grow with the corpus: they are not for a broadcast at any size.
    lost = lost.hint("merge")
    return own.join(lost, own["doc_id"].eqNullSafe(lost["doc_id"]), "left").select(
        own["doc_id"], "text", "lost"
    )


def line_dedup(
    docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text, dropped): dropped lines by their position."""
    joined = _with_losses(docs, min_chars, min_documents)
    types = [pa.int64()] * 3 + [pa.binary(), pa.list_(pa.int32())]
    names = ["doc_id", "n_lines", "n_dropped", "kept_text", "dropped"]
    return joined.mapInArrow(
        lambda b: _drop_lines(b, min_chars, lambda kept, at: (kept, at), names, types), KEPT
    ).withColumn("kept_text", F.decode("kept_text", "UTF-8"))


def digests(
    docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of what ``line_dedup`` keeps."""
    joined = _with_losses(docs, min_chars, min_documents)
    types = [pa.int64()] * 3 + [pa.string()]
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    return joined.mapInArrow(
        lambda b: _drop_lines(
            b, min_chars, lambda kept, _: (hashlib.sha256(kept).hexdigest(),), names, types
        ),
        DIGESTS,
    )
