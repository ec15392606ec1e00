"""Benchmark decontamination by spaced-seed hashing.

Texts become token sequences (runs of word characters in lower case; single
characters in scripts without spaces).  A window of ``window`` tokens of a
document matches one of a benchmark item if they differ in at most two places.
The places of a window make four classes (by place mod 4); each of six fixed
masks keeps two classes and ignores the rest.  Two substitutions touch two
classes at most, so one mask sees equal tokens and the hashes join: no match is
missed.  Windows that join are compared token by token.

Scale: masked hashes of documents meet those of items in a semi-join.  Before it,
a document's hashes pass a filter with the items' hashes, a bit array whose size
doesn't depend on the benchmark's; a larger benchmark lets more of them through,
and the join takes what comes.  To learn whether a document matches at all, its
distinct windows that hit are looked up as they are, and those that no item has
so under the narrow masks, one for each pair of places: windows that share a
narrow mask's hash do match, so one item's window stands for all of them and no
pairs of windows are made, also where many documents and items fill one template.
``find_contamination`` lists the pairs of documents and items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import freeing, groups_of, keyed, materialise
from ._filter import FILTER_BITS, hash_filter, may_hold

#: Tokens of a window, substitutions allowed, and tokens to one substitution in items shorter than a window.
WINDOW, ERRORS, TO_ONE = 13, 2, 6
#: Bytes of documents handled at a time, token hashes that a worker remembers, rows of keys that may be broadcast.
BYTES, CACHE, BROADCAST_ROWS = 2 << 20, 200_000, 200_000

#: Code points of scripts that don't put spaces between words (Thai to Burmese, Khmer, kana, Han).
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_TOKEN = re.compile(f"[{_UNSPACED}]|[^\\W{_UNSPACED}]+")
_RNG = np.random.default_rng(97)
_FACTORS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def tokens(text: str | None) -> np.ndarray:
    """The hashes of a text's tokens."""
    return np.array(list(map(_HASHES.__getitem__, _TOKEN.findall((text or "").lower()))), np.uint64)


def errors_of(window: int, full: int = WINDOW, errors: int = ERRORS) -> int:
    """Substitutions allowed in a window: all of them in a full one, one for TO_ONE tokens in a shorter item."""
    return errors if window == full else min(errors, window // TO_ONE)


def masks(errors: int) -> list[tuple[int, ...]]:
    """Classes of places that each mask keeps: whichever ``errors`` (two at most) classes are touched, a mask leaves them out."""
    if errors > 2:
        raise ValueError("two substitutions at most")
    return [(0, 1, 2, 3)] if not errors else [(0, 1), (2, 3)] if errors == 1 else list(combinations(range(4), 2))


def masked_hashes(ids: np.ndarray, window: int, errors: int) -> np.ndarray:
    """Hashes of all windows of a token sequence, a row for each mask."""
    n = len(ids) - window + 1
    parts = np.zeros((4, n), np.uint64)
    for k in range(window):
        parts[k % 4] += ids[k : k + n] * _FACTORS[k]
    parts ^= parts >> np.uint64(31)
    return np.stack([sum(parts[c] * _FACTORS[60 + i] for i, c in enumerate(kept)) + _FACTORS[50 + m] + np.uint64(window) for m, kept in enumerate(masks(errors))])


def _windows(ids: np.ndarray, at: np.ndarray, window: int) -> pa.Array:
    """Windows at some places as binary values."""
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, window)[at])
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32) * (8 * window)), pa.py_buffer(rows)])


def _item_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch["text"].to_pylist()):
                ids = tokens(text)
                if not len(ids):
                    continue
                w = min(window, len(ids))
                at = np.arange(len(ids) - w + 1)
                which = pa.array(np.full(len(at), k))
                columns = [batch["item"].take(which), batch["ikey"].take(which), pa.array(np.full(len(at), len(ids))), pa.array(np.full(len(at), w)), pa.array(at), _windows(ids, at, w)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "ikey", "size", "w", "place", "win"])

    return rows


def _hash_rows(window: int, errors: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for win in batch["win"]:
                ids = np.frombuffer(win.as_buffer(), np.uint64)
                h = masked_hashes(ids, len(ids), errors_of(len(ids), window, errors))[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([win.as_py()] * len(h), pa.binary())], ["h", "win"])

    return rows


def narrow_hashes(ids: np.ndarray, errors: int) -> np.ndarray:
    """Hashes of one window, each without another set of ``errors`` places; windows of one length match if they share one."""
    terms = ids * _FACTORS[: len(ids)]
    terms ^= terms >> np.uint64(29)
    left_out = list(combinations(range(len(ids)), errors))
    sums = terms.sum() - terms[np.array(left_out, int).reshape(-1, errors)].sum(axis=1) if errors else terms.sum(keepdims=True)
    mark = np.array([sum((p + 1) * 64**k for k, p in enumerate(places)) + len(ids) * 64**3 for places in left_out], np.uint64)
    h = (sums + mark) * _FACTORS[40]
    return h ^ (h >> np.uint64(32))


def _narrow_rows(column: str, window: int, errors: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for win in batch[column]:
                ids = np.frombuffer(win.as_buffer(), np.uint64)
                h = narrow_hashes(ids, errors_of(len(ids), window, errors))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([win.as_py()] * len(h), pa.binary())], ["narrow", column])

    return rows


def _agreeing_rows(window: int, errors: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch["got"], batch["win"], strict=True)
            ids = [(np.frombuffer(got.as_buffer(), np.uint64), np.frombuffer(win.as_buffer(), np.uint64)) for got, win in pairs]
            good = [k for k, (a, b) in enumerate(ids) if len(a) == len(b) and np.count_nonzero(a != b) <= errors_of(len(a), window, errors)]
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(good, pa.int64())) for c in ("got", "win")], ["got", "win"])

    return rows


def _seed_rows(lengths: list[int], window: int, errors: int, bits: np.ndarray, filter_bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            column = whole["__t"]
            for a, b in groups_of((len(t.as_buffer()) + 1 if t.is_valid else 1 for t in column), BYTES):
                texts = [tokens(t.as_py()) for t in column.slice(a, b - a)]
                ids, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
                for w in lengths:
                    if len(ids) < w:
                        continue
                    for h in masked_hashes(ids, w, errors_of(w, window, errors)):
                        at = may_hold(bits, h, filter_bits)
                        text = np.searchsorted(ends, at, side="right")
                        inside = at + w <= ends[text]
                        at, text = at[inside], text[inside]
                        if len(at):
                            which = pa.array(text + a)
                            begins = np.r_[0, ends[:-1]]
                            columns = [whole["__id"].take(which), whole["__th"].take(which), pa.array((ends - begins)[text]), pa.array(at - begins[text]), pa.array(h[at].view(np.int64)), _windows(ids, at, w)]
                            yield pa.RecordBatch.from_arrays(columns, ["__id", "__th", "n", "at", "h", "got"])
        _HASHES.clear()  # the worker may run other stages next

    return rows


def _verified_rows(window: int, errors: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for k, (got, win) in enumerate(zip(batch["got"], batch["win"], strict=True)):
                a, b = np.frombuffer(got.as_buffer(), np.uint64), np.frombuffer(win.as_buffer(), np.uint64)
                if len(a) == len(b) and np.count_nonzero(a != b) <= errors_of(len(a), window, errors):
                    good.append(k)
            names = ["__id", "__th", "at", "win"]
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(good, pa.int64())) for c in names], names)

    return rows


def _seeds(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, errors: int, filter_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places of the items' windows, their masked hashes, and the documents' windows that may have one of these."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")).withColumn("ikey", F.xxhash64(F.col("item").cast("string"), "text")).dropDuplicates(["ikey"])
    kind = items.schema["item"].dataType.simpleString()
    places = materialise(items.mapInArrow(_item_rows(window), f"item {kind}, ikey long, size long, w long, place long, win binary"), "items")
    hashes = materialise(places.select("win").distinct().mapInArrow(_hash_rows(window, errors), "h long, win binary"), "seeds")
    lengths = [r["w"] for r in places.select("w").distinct().collect()]  # as many as a window has tokens, at most
    texts = keyed(docs, id_col, text_col).select("__id", "__th", F.col(f"`{text_col}`").cast("string").alias("__t"))
    seeds = texts.mapInArrow(freeing(_seed_rows(sorted(lengths), window, errors, hash_filter(hashes, "h", filter_bits), filter_bits)), "__id string, __th long, n long, at long, h long, got binary")
    return places, hashes, seeds


def matching_windows(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, errors: int = ERRORS, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(__id, __th, n, at, w, item): every window of a document, keyed as ``keyed`` does, that matches one of an item.

    ``n`` is the document's number of tokens, ``at`` and ``w`` the window's place and
    length, ``item`` the least item that has the window's match (or one of its
    matches: of those under one narrow mask a single window is looked at).
    """
    places, hashes, seeds = _seeds(docs, benchmark, id_col, text_col, item_col, item_text_col, window, errors, filter_bits)
    hits = materialise(seeds.join(hashes.select("h").distinct(), "h", "left_semi"), "hits")
    windows = hits.select("got").distinct()
    wins = hashes.select("win").distinct()
    same = windows.join(wins, F.col("got") == F.col("win"))
    others = materialise(windows.join(wins, F.col("got") == F.col("win"), "left_anti"), "others")
    # Of the items' windows only those that the others hit are hashed narrowly.
    hit = hits.join(others, "got", "left_semi").select("h").distinct()
    narrow = hashes.join(hit, "h", "left_semi").select("win").distinct().mapInArrow(_narrow_rows("win", window, errors), "narrow long, win binary")
    narrow = narrow.groupBy("narrow").agg(F.min("win").alias("win"))
    near = others.mapInArrow(_narrow_rows("got", window, errors), "narrow long, got binary").join(narrow, "narrow").groupBy("got").agg(F.min("win").alias("win"))
    matched = same.unionByName(near.mapInArrow(_agreeing_rows(window, errors), "got binary, win binary"))
    named = matched.join(places.groupBy("win").agg(F.min("item").alias("item")), "win").select("got", "item")
    found = hits.select("__id", "__th", "n", "at", "got").distinct().join(named, "got")
    return found.select("__id", "__th", "n", "at", (F.octet_length("got") / 8).cast("long").alias("w"), "item")


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """(__id, __th, item, windows, covered, share, start, stop), one row for each document that overlaps with an item.

    ``windows`` of its windows match one of an item, ``covered`` of its tokens
    (``share`` of all) lie in them, from ``start`` up to ``stop``; ``item`` is the least
    of those that ``matching_windows`` names.  Parameters are those of that function.
    """
    found = matching_windows(docs, benchmark, **more).groupBy("__id", "__th").agg(
        F.min("item").alias("item"), F.first("n").alias("n"), F.count(F.lit(1)).alias("windows"), F.min("at").alias("start"), F.max(F.col("at") + F.col("w")).alias("stop"), F.sort_array(F.collect_list(F.struct("at", "w"))).alias("p")
    )
    # Sorted by place, a window adds what reaches beyond those before it.
    grown = lambda s, p: F.struct((s["covered"] + F.greatest(F.lit(0), p["at"] + p["w"] - F.greatest(s["end"], p["at"]))).alias("covered"), F.greatest(s["end"], p["at"] + p["w"]).alias("end"))
    zero = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate("p", zero, grown, lambda s: s["covered"])
    return found.select("__id", "__th", "item", "windows", covered.alias("covered"), (covered / F.col("n")).alias("share"), "start", "stop")


def find_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, errors: int = ERRORS, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(__id, __th, item, windows, covered, share, start, stop) for each document, keyed as ``keyed`` does, and item that overlap; see ``find_contamination``."""
    places, hashes, seeds = _seeds(docs, benchmark, id_col, text_col, item_col, item_text_col, window, errors, filter_bits)
    matches = seeds.join(hashes, "h").select("__id", "__th", "at", "got", "win").mapInArrow(_verified_rows(window, errors), "__id string, __th long, at long, win binary").distinct()
    found = matches.join(places, "win").groupBy("__id", "__th", "ikey").agg(
        F.first("item").alias("item"), F.first("size").alias("size"), F.first("w").alias("w"), F.count(F.lit(1)).alias("windows"),
        F.sort_array(F.collect_set("place")).alias("p"), F.min("at").alias("start"), F.max("at").alias("last"),
    )
    steps = F.transform(F.col("p"), lambda p, k: F.when(k > 0, F.least(p - F.element_at("p", k.cast("int")), F.col("w"))).otherwise(F.col("w")))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)
    return materialise(
        found.select("__id", "__th", "item", "windows", covered.alias("covered"), (covered / F.col("size")).alias("share"), "start", (F.col("last") + F.col("w")).alias("stop")),
        "overlaps",
    )


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, errors: int = ERRORS, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """All columns of ``docs``, and ``overlaps``: array of (item, windows, covered, share, start, stop), one element for each item found, by item.

    ``windows`` counts the matching pairs of windows; ``covered`` and ``share``
    say how many of the item's tokens lie in them; [start, stop) is the part of
    the document's tokens from the first to the last of them.  Items shorter than
    ``window`` are one window with one substitution for each six tokens, two at
    most; so those of under six tokens match exactly or not.  Items without tokens
    (empty and null too) match nothing; null and empty documents have no overlap.
    Items equal in id and text count once; repeated documents get equal rows.  An
    input column ``overlaps`` is replaced.  Empty tables: no rows, or no overlaps.
    """
    docs = docs.drop("overlaps")
    found = find_overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col, window, errors, filter_bits)
    element = F.struct("item", "windows", "covered", "share", "start", "stop")
    lists = found.groupBy("__id", "__th").agg(F.sort_array(F.collect_list(element)).alias("overlaps"))
    joined = keyed(docs, id_col, text_col).join(lists, ["__id", "__th"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("overlaps", F.array().cast(lists.schema["overlaps"].dataType)).alias("overlaps"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, **more) -> DataFrame:
    """The rows of ``docs`` without an overlap of ``least`` tokens with an item and that aren't nothing but a shorter item, with their columns.

    An item of a word or two is in many texts, so it condemns only one that has
    nothing else.  Null and empty texts stay; repeated rows stay or go together;
    equal texts under different ids have one fate; an empty benchmark condemns
    none, an empty table gives an empty one.  The keys of what goes are broadcast
    if they are no more than BROADCAST_ROWS, else joined by a shuffle.
    """
    found = matching_windows(docs, benchmark, id_col=id_col, text_col=text_col, **more)
    gone = found.filter((F.col("w") >= least) | (F.col("w") == F.col("n"))).select("__id", "__th").distinct()
    gone = materialise(gone, "contaminated")
    small = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return keyed(docs, id_col, text_col).join(small, ["__id", "__th"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
