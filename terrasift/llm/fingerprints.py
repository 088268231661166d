"""Document fingerprints by one-permutation MinHash.

Each shingle is hashed once; the top bits choose its bin and each bin keeps its least hash. Empty bins borrow by
optimal densification: bin i takes the value of the first filled bin in a random order of its own. Of each
value the low BITS bits are packed. Two unequal values agree in so few bits with probability C = 2^-BITS, so the
share of agreeing bins s gives the likeness (s - C) / (1 - C).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrasift.llm.common import shingles, stored, texts, tune

BINS, BITS, WORDS = 512, 4, 5
_SHIFT = np.uint64(64 - (BINS - 1).bit_length())
_orders: np.ndarray | None = None


def orders() -> np.ndarray:
    """For each bin the order in which it asks the others: fixed by a seed, equal everywhere."""
    global _orders
    if _orders is None:
        rng = np.random.Generator(np.random.PCG64(20240607))
        _orders = np.stack([rng.permutation(BINS) for _ in range(BINS)]).astype(np.int16)
    return _orders


def fingerprint(h: np.ndarray) -> bytes:
    """Packed bits of the sorted distinct shingle hashes of a set; nothing for the empty set."""
    if not len(h):
        return b""
    at = (h >> _SHIFT).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    value = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    value[at[first]], full[at[first]] = h[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        asked = orders()
        for width in (16, BINS):
            filled = full[asked[empty, :width]]
            if filled.any(axis=1).all():
                break
        value[empty] = value[asked[empty, filled.argmax(axis=1)]]
    low = (value & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two fingerprints. Two empty sets are alike, an empty and another not."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    same = (np.count_nonzero(x >> 4 == 0) + np.count_nonzero(x & 15 == 0)) / BINS
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def of_text(text: bytes) -> bytes:
    return fingerprint(shingles(text, WORDS))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """docs with column `fingerprint` binary of the whole text (null and wordless texts: empty). A column of that name is replaced."""
    tune(docs.sparkSession)
    kept = docs.drop("fingerprint")

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([of_text(t) for t in texts(b)], pa.binary())], names=[*b.schema.names, "fingerprint"])

    from pyspark.sql import types as T

    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField("fingerprint", T.BinaryType())]))


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as much of the beginning of `after`, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
#: kind 0: a result; 1: the first document of a partition; 2: the last, which waits for the next partition's first.
EDGES = pa.schema([*RESULT, ("kind", pa.int32()), ("part", pa.int64()), ("text", pa.string())])


def _result(doc_id: int | None, text: str, own: bytes, after: str, next_print: bytes) -> dict:
    other = edited(text, after).encode()
    print_ = of_text(other)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(other).hexdigest(), "fingerprint": own, "edited_fingerprint": print_, "near_edited": likeness(own, print_), "near_next": likeness(own, next_print)}


def _along(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order: each is finished when its successor comes. Only one document is held over."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None
    for b in it:
        out = []
        for doc_id, raw in zip(b.column(0).to_pylist(), texts(b), strict=True):
            text, own = raw.decode(), of_text(raw)
            if held is None:
                out.append({"doc_id": doc_id, "kind": 1, "part": part, "text": text})
            else:
                out.append(_result(*held, text, own) | {"kind": 0})
            held = doc_id, text, own
        yield pa.RecordBatch.from_pylist(out, EDGES)
    if held is not None:
        yield pa.RecordBatch.from_pylist([{"doc_id": held[0], "kind": 2, "part": part, "text": held[1]}], EDGES)


def _edges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
        yield pa.RecordBatch.from_pylist([_result(i, t, of_text(t.encode()), n, of_text(n.encode())) for i, t, n in rows], RESULT)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next of each row.

    The next document is that of the next lower id (null ids come last, equal ids go by their text's hash, then
    text), and the first for the last. Null texts are empty; an only row is its own next; an empty table gives no
    rows. Texts are dealt by ranges of the id, once; each range's last document finds its successor afterwards.
    """
    spark = docs.sparkSession
    tune(spark)
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = t.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    done = stored(dealt.mapInArrow(_along, f"{RESULT_DDL}, kind int, part long, text string"), "prints")
    first = done.where("kind = 1").select("part", F.col("text").alias("next_text"))
    # One row for each partition that has documents; the last wraps to the first.
    turn = first.select("part").withColumn("after", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    last = done.where("kind = 2").select("doc_id", "text", "part").join(turn, "part")
    ends = last.join(first.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "next_text").mapInArrow(_edges, RESULT_DDL)
    out = done.where("kind = 0").select(*RESULT.names).unionByName(ends)
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", "edited_sha256", hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")
