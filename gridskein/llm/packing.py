"""Best-fit packing of tokenised documents by the sum-of-squares rule.

Documents become token ids, longer ones are cut, and the pieces go to bins of
``capacity`` tokens.  The sum-of-squares rule puts a piece where the sum of the
squared counts N(g) of open bins by residual gap g becomes smallest, so no gap
becomes common.  Pieces are placed in order of decreasing length, which the rule
allows and which leaves fewer bins open.

Scale: a table of pieces (without their ids) is written once; it is dealt
evenly, whatever keys repeat, into pools of about ``POOL`` pieces, and each pool
is packed by one task in bounded memory.  A pool leaves a few bins half empty,
a few in ten thousand of its size.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import freeing, materialise

#: Pieces that one task packs.
POOL = 60_000
#: Pre-tokens whose ids a worker remembers.
CACHE = 100_000
#: Texts of these characters only are split by the pattern below; in them it agrees with the tokenizer's own.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ɏ]*", re.ASCII)
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\\[-`{-~]+|\\s+(?!\\S)|\\s+")


class Encoder:
    """Token ids of texts as little-endian 32-bit words, by a ``tokenizers`` file; repeated pre-tokens are remembered.

    ``ranks`` may name the same vocabulary as a file of ``tiktoken`` ranks: single
    pre-tokens are then encoded by that library, several times as fast.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.single = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                vocabulary = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.single = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=vocabulary, special_tokens={})._encode_single_piece

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        if self.single is None:
            return self._direct(words)
        single = self.single
        return [struct.pack(f"<{len(i)}I", *i) for i in (single(w.encode()) for w in words)]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_SPLIT.findall(t) if _PLAIN.fullmatch(t) else None for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(set(chain.from_iterable(s for s in split if s)) - self.known.keys())
        self.known.update(zip(new, self._words(new), strict=True))
        odd = iter(self._direct([t for t, s in zip(texts, split, strict=True) if s is None]))
        get = self.known.__getitem__
        return [next(odd) if s is None else b"".join(map(get, s)) for s in split]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, ranks: str | None = None) -> Encoder:
    """The worker's encoder for these files."""
    if (path, ranks) not in _ENCODERS:
        _ENCODERS[path, ranks] = Encoder(path, ranks)
    return _ENCODERS[path, ranks]


def _piece_rows(path: str, ranks: str | None, capacity: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, ranks)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                out: list[tuple] = []
                for k, ids in enumerate(own.encode([t or "" for t in part["text"].to_pylist()])):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                    out += [(k, j, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                at, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part["id"].take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )
        own.known.clear()  # the worker may run other stages next

    return rows


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; none has the gap 0 or `capacity`
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.int64(1) << 60
    for k, size in enumerate(lengths.tolist()):
        if size < capacity:
            # Twice the change of the sum of squares, halved: N(g - size) - N(g) + 1, over all gaps g from `size`.
            change = count[: capacity - size + 1] - count[size:]
            change *= 2
            change += 2
            change[0] -= 1  # a full bin counts no more
            change[-1] -= 1  # a new bin takes none away
            change[:-1][count[size:-1] == 0] = far
            gap = size + int(change.argmin())
        else:
            gap = capacity
        if gap == capacity:
            own, n = n, n + 1
        else:
            own = stacks[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = own, capacity - gap
        if gap > size:
            stacks[gap - size].append(own)
            count[gap - size] += 1
    return bins, offsets


def _pack_rows(capacity: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        pool = pa.Table.from_batches(held)
        # A total order up to equal rows: a task that runs again packs alike.
        pool = pool.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = sum_of_squares(pool["length"].to_numpy(), capacity)
        base = TaskContext.get().partitionId() << 40
        pool = pool.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
        yield from pool.to_batches(max_chunksize=10_000)

    return rows


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, pool: int = POOL, ranks: str | None = None) -> DataFrame:
    """One row per piece: the id column, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids by the ``tokenizers`` file at ``tokenizer`` (a path
    that all executors have; ``ranks``: see Encoder), without special tokens, then id 0; null texts count
    as empty and so have one id.  Only documents of more than ``capacity`` ids are
    cut, into pieces of that many; the first is shorter where they don't come out
    even.  Pieces lie in a sequence without gaps, from offset 0.  Repeated rows
    and null ids are packed like any other; further columns are ignored.  An
    empty table gives an empty one.
    """
    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = materialise(texts.mapInArrow(freeing(_piece_rows(tokenizer, ranks, capacity)), schema), "pieces")
    pools = -(-pieces.count() // pool)
    packed = pieces.repartition(max(1, pools)).mapInArrow(freeing(_pack_rows(capacity)), f"{schema}, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
