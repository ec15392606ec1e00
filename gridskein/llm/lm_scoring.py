"""Scoring of whole documents by a gated recurrent language model.

Words are lower-cased runs between white space; a document ends with one end
token.  Counts of all words of all training documents make the output
distribution: the most frequent words get classes by rank and are predicted by a
class-factored softmax over the recurrent state; every other word is predicted
by the class of its last letters and then its own count in that class (words
never seen share one place in each class).  The state is carried through a
document from its first token to its last.

Scale: word counts are summed with map-side combination under 64-bit hashes.
The TOP most frequent words, a fixed number, go to all tasks; scoring needs a
shuffle for the remaining words only, which aren't frequent, so no key is hot.
Texts are encoded once, two bytes a token; training and scoring read that.  The
recurrent weights are trained on the whole texts of all training documents, in
shards of about ``SHARD`` tokens dealt and ordered by a hash of their rows (the
weights don't depend on how files are split), and averaged; they have a fixed size.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _gru
from ._common import groups_of, materialise

#: Most frequent words that all tasks hold.
TOP = 100_000
#: Different words a task counts before it passes them on, and words a worker remembers.
FLUSH, REMEMBER = 400_000, 400_000
#: Tokens encoded or trained on at a time, tokens scored side by side (a longer document is taken alone), and tokens of a training shard.
TOKENS, SIDE, SHARD = 1_000_000, 4_000_000, 4_000_000
#: Added to every count.
ADD = 0.1

_END = b" "  # no word has a space


def _signed(hashes: np.ndarray) -> np.ndarray:
    """Hashes of words as tables hold them."""
    return hashes.view(np.int64) ^ np.int64(-(1 << 63))


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class _RareClasses(dict):
    """Classes of words that aren't frequent, by their last three bytes."""

    def __missing__(self, ending: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        self[ending] = found = xxhash.xxh32_intdigest(ending, 1) % _gru.RARE
        return found


_RARE = _RareClasses()


def words_of(text: bytes | None) -> list[bytes]:
    """A document's tokens with the end."""
    words = (text or b"").lower().split()
    words.append(_END)
    return words


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts))
        rare = np.fromiter((_RARE[w[-3:]] for w in counts), np.int32, len(counts))
        n = np.fromiter(counts.values(), np.int64, len(counts))
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(_signed(hashes)), pa.array(rare), pa.array(n)], ["h", "rare", "n"])

    for batch in batches:
        for text in batch["__t"]:
            counts.update(words_of(text.as_py()))
            if len(counts) > FLUSH:
                yield flush()
    if counts:
        yield flush()


class _Coder(dict):
    """Codes of words, and for each code its hash, model id and count (-1: not among the top words)."""

    def __init__(self, top: np.ndarray, counts: np.ndarray):
        super().__init__()
        self.rank = np.argsort(top)  # the top words come in order of count
        self.top, self.count_of = top[self.rank], counts[self.rank]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self._hashes, self._rare = array("Q"), array("h")
        self.hashes, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self._hashes.append(xxhash.xxh64_intdigest(word))
        self._rare.append(_RARE[word[-3:]])
        self[word] = code = len(self)
        return code

    def encode(self, text: bytes | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def look_up(self) -> None:
        """Hashes, ids and counts of the codes given out since the last time."""
        hashes, rare = _signed(np.array(self._hashes, np.uint64)), np.array(self._rare, np.int16)
        self._hashes, self._rare = array("Q"), array("h")
        at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
        found = self.top[at] == hashes
        rank = np.where(found, self.rank[at], _gru.VOCABULARY)
        self.hashes = np.concatenate([self.hashes, hashes])
        self.ids = np.concatenate([self.ids, np.where(rank < _gru.VOCABULARY, rank, _gru.VOCABULARY + rare).astype(np.int16)])
        self.known = np.concatenate([self.known, np.where(found, self.count_of[at], -1)])


def _encode_rows(names: list[str], top: np.ndarray, counts: np.ndarray, rare_norms: np.ndarray):
    tail_kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(top, counts)

        def encoded(batch: pa.RecordBatch, codes: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(c) for c in codes], np.int64)
            n, doc, codes = len(sizes), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.concatenate(codes)
            coder.look_up()
            known_of = coder.known
            log_of = np.where(known_of >= 0, np.log10(np.maximum(known_of, 0) + ADD), 0)
            ids_of = coder.ids
            # A rare word's own share of its class: its count now or, for the tail, after the join.
            rare_of = np.where(ids_of >= _gru.VOCABULARY, log_of - rare_norms[np.maximum(ids_of - _gru.VOCABULARY, 0)], 0)
            base, own = np.bincount(doc, log_of[codes], minlength=n), np.bincount(doc, rare_of[codes], minlength=n)
            sums = np.bincount(doc, (known_of > 0)[codes], minlength=n).astype(np.int64)
            tail = np.flatnonzero((known_of < 0)[codes])
            pair, times = np.unique(doc[tail] * np.int64(len(known_of)) + codes[tail], return_counts=True)
            at, code = np.divmod(pair, len(known_of))
            parts = pa.StructArray.from_arrays([pa.array(coder.hashes[code]), pa.array(times)], ["h", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32()), parts).cast(tail_kind)
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64) * 2
            ids = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids_of[codes])]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(sizes), pa.array(sums), pa.array(base), pa.array(own), ids, lists], [*names, "__n", "__known", "__base", "__own", "__ids", "__tail"])

        for batch in batches:
            codes, first, have = [], 0, 0
            for k, text in enumerate(batch["__t"]):
                codes.append(coder.encode(text.as_py()))
                have += len(codes[-1])
                if have >= TOKENS or k + 1 == batch.num_rows:
                    yield encoded(batch.slice(first, len(codes)), codes)
                    codes, first, have = [], k + 1, 0
                    if len(coder) > REMEMBER:
                        coder.forget()

    return rows


def _ids_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int16) for x in column]


def _train_rows(start: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, held, have = _gru.Trainer(_gru.unflat(start)), [], 0
        for batch in batches:
            for ids in _ids_of(batch["__ids"]):
                held.append(ids)
                have += len(ids)
                if have >= TOKENS:
                    trainer.train(held)
                    held, have = [], 0
        if held:
            trainer.train(held)
        if trainer.seen:
            weights = trainer.values.astype(np.float64) * trainer.seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(weights) + 1)), pa.array(np.r_[weights, trainer.seen])], ["k", "w"])

    return rows


def _score_rows(names: list[str], weights: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _gru.unflat(weights)
        for batch in batches:
            sizes = batch["__n"].to_numpy()
            for a, b in groups_of(sizes, SIDE):
                value = _gru.score(model, np.concatenate(_ids_of(batch["__ids"].slice(a, b - a))), sizes[a:b]) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(a, b - a) for c in names), pa.array(value)], [*names, "__score"])

    return rows


@dataclass(frozen=True)
class Vocabulary:
    """All counts (a table h, rare, n), the top words of it, and sums: tokens, distinct words, tokens of frequent words and of rare classes, log10 of the latters' totals."""

    table: DataFrame
    top: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    frequent: np.ndarray
    rare: np.ndarray
    rare_norms: np.ndarray


@dataclass(frozen=True)
class LanguageModel:
    """The words, the recurrent weights and the number of tokens that trained them."""

    words: Vocabulary
    weights: np.ndarray
    trained: int

    @property
    def tokens(self) -> int:
        return self.words.tokens


def _bytes_of(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return docs.select(*more, F.col(f"`{text_col}`").cast("string").cast("binary").alias("__t"))


def count_words(docs: DataFrame, text_col: str = "text", top: int = TOP) -> Vocabulary:
    """Counts of all words of ``docs`` (null texts: empty)."""
    counted = _bytes_of(docs, text_col).mapInArrow(_count_rows, "h long, rare int, n long")
    counted = materialise(counted.groupBy("h").agg(F.first("rare").alias("rare"), F.sum("n").alias("n")), "counts")
    sizes = counted.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect()
    least, have = 1 << 62, 0
    for row in sizes:  # the count from which on there are no more than `top` words, or those counted 100,000 times
        if have + row["m"] > top and have:
            break
        least, have = row["n"], have + row["m"]
    end = _hash(_END)
    is_end = F.col("h") == end
    best = counted.filter((F.col("n") >= least) | is_end).orderBy(F.desc(is_end), F.desc("n"), "h").limit(top).select("h", "rare", "n").toPandas()
    hashes, counts = best["h"].to_numpy(np.int64), best["n"].to_numpy(np.int64)
    if not len(hashes):  # no training document
        hashes, counts = np.array([end], np.int64), np.zeros(1, np.int64)
    frequent = np.zeros(_gru.VOCABULARY)
    frequent[: min(len(counts), _gru.VOCABULARY)] = counts[: _gru.VOCABULARY]
    rare = np.zeros((_gru.RARE, 2))
    for row in counted.groupBy("rare").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).collect():
        rare[row["rare"]] = row["n"], row["m"]
    model_words = best.iloc[: _gru.VOCABULARY]
    np.subtract.at(rare, model_words["rare"].to_numpy(int), np.stack([model_words["n"], np.ones(len(model_words))], axis=1))
    tokens, distinct = int(frequent.sum() + rare[:, 0].sum()), int((frequent > 0).sum() + rare[:, 1].sum())
    return Vocabulary(counted, hashes, counts, tokens, distinct, frequent, rare[:, 0], np.log10(rare[:, 0] + ADD * (rare[:, 1] + 1)))


def encode_documents(docs: DataFrame, words: Vocabulary, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` (None: all) of ``docs`` with each text's model ids and what counts say of it, in columns that begin with ``__``; written to the shared folder."""
    names = docs.columns if columns is None else columns
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in names]).schema]
    ddl = ", ".join([*kinds, "__n long, __known long, __base double, __own double, __ids binary, __tail array<struct<h:long,n:long>>"])
    encoded = _bytes_of(docs, text_col, *[F.col(f"`{c}`") for c in names]).mapInArrow(_encode_rows(names, words.top, words.counts, words.rare_norms), ddl)
    return materialise(encoded.withColumn("__row", F.monotonically_increasing_id()), "encoded")


def train_on_encoded(encoded: DataFrame, words: Vocabulary) -> LanguageModel:
    """Train the recurrent weights on all of the encoded documents."""
    start = _gru.flat(_gru.initial(words.frequent, words.rare))
    shards = max(1, -(-words.tokens // SHARD))
    # Rows equal in text differ in other columns, such as an id: copies are spread over the shards.
    own = [F.col(f"`{c}`").cast("string") for c in encoded.columns if not c.startswith("__")]
    dealt = encoded.select("__ids", F.xxhash64("__ids", *own).alias("__h")).repartition(shards, "__h").sortWithinPartitions("__h").select("__ids")
    trained = dealt.mapInArrow(_train_rows(start), "k long, w double")
    summed = trained.groupBy("k").agg(F.sum("w").alias("w")).toPandas().sort_values("k")["w"].to_numpy()
    if not len(summed):
        return LanguageModel(words, start, 0)
    return LanguageModel(words, (summed[:-1] / summed[-1]).astype(np.float32), int(summed[-1]))


def score_encoded(encoded: DataFrame, model: LanguageModel) -> DataFrame:
    """Scores of encoded documents: their columns without the encoding, and those of ``score_documents``."""
    names = [c for c in encoded.columns if c not in ("__n", "__known", "__base", "__own", "__ids", "__tail", "__row")]
    keep = [*names, "__n", "__known", "__base", "__own", "__row"]
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep)
    scored = encoded.select(*[F.col(f"`{c}`") for c in keep], "__ids").mapInArrow(_score_rows(keep, model.weights), f"{kinds}, __score double")
    tail = encoded.select("__row", F.explode("__tail").alias("t")).select("__row", "t.h", F.col("t.n").alias("n"))
    counts = model.words.table.select("h", F.col("n").alias("c"))
    tail = tail.join(counts, "h", "left").groupBy("__row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("__more"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("__seen"),
    )
    joined = scored.join(tail, "__row", "left")
    more = F.coalesce("__more", F.lit(0.0))
    norm = float(np.log10(model.words.tokens + ADD * (model.words.distinct + 1)))
    return joined.select(
        *[F.col(f"`{c}`") for c in names],
        F.col("__n").alias("n_tokens"),
        (F.col("__known") + F.coalesce("__seen", F.lit(0))).alias("n_known"),
        (F.col("__base") + more - F.col("__n") * norm).alias("base_score"),
        (F.col("__score") + F.col("__own") + more).alias("score"),
    )


def train_language_model(docs: DataFrame, text_col: str = "text", top: int = TOP) -> LanguageModel:
    """A model of ``docs`` (null texts: empty): counts and recurrent weights come from all of them."""
    words = count_words(docs, text_col, top)
    others = [c for c in docs.columns if c != text_col]
    return train_on_encoded(encode_documents(docs, words, text_col, others), words)


def score_documents(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and n_tokens, n_known, base_score and score.

    n_tokens counts words and the end, n_known those that occur in training.
    base_score is the log10 probability by counts with ADD added, score the
    model's; both of the whole text.  Null and empty texts have the end alone.
    Repeated rows score alike.  Input columns of those names are replaced; an
    empty table gives an empty one.  Without training documents all words are
    unknown and the model is uniform.
    """
    docs = docs.drop("n_tokens", "n_known", "base_score", "score")
    return score_encoded(encode_documents(docs, model.words, text_col), model)
