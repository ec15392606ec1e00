"""SimHash near-dedup by Golay-code fuzzy hashing.

A fingerprint's 64 bits make three segments (22, 21 and 21 bits, as words of
the perfect Golay code of 23 bits, filled up with zeros).  A segment decodes to
one codeword, and so do the words one bit away from it: together one to six
codeword indices.  Two segments that differ in up to two bits have a word
between them that is at most one bit from both, hence share an index.  By the
pigeonhole principle two errors leave one of three segments without any; so the
keys pair each segment's own bits with each index of the next segment, about
16 keys of 34 bits, and no link is missed.  Fingerprints that share a key are
compared bit by bit.

Scale: equal fingerprints are one before keys are made.  A key shared by more
than ``HOT`` fingerprints isn't compared pairwise: its fingerprints are expanded
to themselves and the 64 words one bit away, and two of them link exactly if
they share such a word, so those groups have 65 members at most and the work is
in proportion to the fingerprints.  Links become components by contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import freeing, keyed, materialise
from ..operators.components import connected_components

#: Fingerprints under one key that are compared pairwise.
HOT = 128
#: Bits of each segment.
SEGMENTS = (22, 21, 21)
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code of 23 bits.
GENERATOR = 0b101011100011


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits, and of all words of up to 11 bits; the error with each remainder."""
    words = np.arange(1 << 23, dtype=np.uint32)[:: 1 << 11].copy()
    low = np.arange(1 << 11, dtype=np.uint32)
    for bit in range(22, 10, -1):
        words = np.where(words >> np.uint32(bit) & np.uint32(1), words ^ np.uint32(GENERATOR << (bit - 11)), words)
    errors = np.zeros(1 << 11, np.uint32)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            errors[words[e >> 11] ^ (e & 0x7FF)] = e
    return words, low, errors


_TABLES: list = []


def golay_indices(words: np.ndarray) -> np.ndarray:
    """The index of the codeword nearest to each word of 23 bits (12 bits)."""
    if not _TABLES:
        _TABLES.append(_golay())
    high, low, errors = _TABLES[0]
    fixed = words ^ errors[high[words >> np.uint32(11)] ^ low[words & np.uint32(0x7FF)]]
    return fixed >> np.uint32(11)


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of some fingerprints (uint64)."""
    segments, shift = [], 0
    for bits in SEGMENTS:
        segments.append(((fingerprints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.uint32))
        shift += bits
    rows, keys = [], []
    for s in range(3):
        own, other, bits = segments[s], segments[(s + 1) % 3], SEGMENTS[(s + 1) % 3]
        flips = np.r_[0, 1 << np.arange(bits)].astype(np.uint32)
        indices = np.sort(golay_indices(other[:, None] ^ flips[None, :]), axis=1)
        new = np.ones(indices.shape, bool)
        new[:, 1:] = indices[:, 1:] != indices[:, :-1]
        row, column = np.nonzero(new)
        rows.append(row)
        keys.append(np.int64(s) << 60 | own[row].astype(np.int64) << 12 | indices[row, column].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text's word shingles; 0 if it has no word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) >= 3:
        starts, ends = starts[:-2], ends[2:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for s in range(0, len(h), 4096):
        part = h[s : s + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch["__t"]], np.uint64)
        yield pa.RecordBatch.from_arrays([batch["__id"], batch["__th"], batch["id"], pa.array(prints.view(np.int64))], ["__id", "__th", "id", "fp"])


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch["fp"].to_numpy()
        row, key = fuzzy_keys(prints.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row])], ["key", "fp"])


def _link_rows(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["fps"]
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            a, b = [], []
            for step in range(1, int(sizes.max(initial=1))):
                left = np.flatnonzero(np.arange(len(flat)) + step < np.repeat(ends, sizes))
                x, y = flat[left], flat[left + step]
                near = np.bitwise_count((x ^ y).view(np.uint64)) <= bits
                a.append(x[near])
                b.append(y[near])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return rows


def fingerprint_links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) that join all fingerprints (fp: long, distinct) with 2 or fewer differing bits.

    Under cold keys every such pair is a link; under hot ones the pairs are linked through the least of those that share a word.
    """
    keys = prints.mapInArrow(freeing(_key_rows), "key long, fp long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    found = materialise(keys.join(shared, "key"), "keys")
    lists = found.filter(F.col("m") <= hot).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    cold = lists.mapInArrow(freeing(_link_rows(2)), "a long, b long")
    words = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: F.when(i == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    dense = found.filter(F.col("m") > hot).select("fp").distinct()
    around = dense.select("fp", F.explode(words).alias("word")).groupBy("word").agg(F.collect_list("fp").alias("fps"))
    around = around.filter(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return cold.unionByName(around)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: (__id, __th, id, fp, component_id, first_id, first_th).

    ``fp`` is the fingerprint; ``component_id`` the least id reachable over links
    of 2 or fewer differing bits; (first_id, first_th) the key of the row that has
    it.  Null and empty texts, and texts without words, have fingerprint 0 and
    link like any other.  Null ids come after all others; a component without an
    id has a null component_id.  Repeated rows each give a row.  Further columns
    are ignored.  An empty table gives an empty one.
    """
    texts = keyed(docs, id_col, text_col).select("__id", "__th", F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("__t"))
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    prints = materialise(texts.mapInArrow(freeing(_fingerprint_rows), f"__id string, __th long, id {kind}, fp long"), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("__id").alias("k"), F.col("__th").alias("h"))
    distinct = materialise(prints.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), hot))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialise(named, "roots")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    least = named.join(least, "root").select("fp", F.col("least.id").alias("component_id"), F.col("least.k").alias("first_id"), F.col("least.h").alias("first_th"))
    return prints.join(least, "fp").select("__id", "__th", "id", "fp", "component_id", "first_id", "first_th")


def fingerprint_hex(fp):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
