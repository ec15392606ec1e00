"""Suffix-array dedup: remove the bytes covered by long strings that occur elsewhere too.

Method: bucket-pointer refinement, spread over a cluster.  Only *anchors* get
into the suffix array: of all q-grams of a window of ``length`` bytes the
leftmost with the least bucket identifier, so equal windows have anchors at
equal offsets and none is missed.  An anchor stands for a run of windows, and
the bytes of that run are its context.

Each level splits runs of windows into shorter ones and sorts them into buckets
by the identifier of the *core*, the bytes that all windows of a run share.  A
run alone in its bucket has no repeated window and is done; runs with equal
contexts are repeated as a whole and done too.  What remains goes to the next
level, which reuses the identifiers of the level before:

1. whole runs, then their halves left and right of the middle (identifiers of
   later and earlier offsets, made in the scan that finds the anchors);
2. an eighth of a half;
3. single windows.

Contexts are compared by two 64-bit identifiers of different strings.

Scale: one scan of the texts yields an anchor for about 150 bytes; all shuffles
but two move anchors, not texts.  Every level only counts: no bucket is gathered
in a task, copies are combined before each shuffle, and a level adds a fixed
number of rows for a run that is open, whatever the bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, freeing, keyed, materialise
from ._repeat_kernel import Q, anchors, half_ids, qgram_buckets

#: Bytes of text handled at a time (the arrays then fit a processor's cache).
CHUNK = 1 << 16
#: Bytes of a longer text handled at a time.
PIECE = 1 << 20
#: Parts of half a run of windows at the second level.
PARTS = 8
#: Runs of windows that a task expands at a time.
RUNS = 1000

_ANCHOR = "__id string, __th long, x long, lo long, hi long, h long, f long, a long, b long"
_BODY = "__id string, __th long, x long, s long, e long, settled boolean, body binary"
_PART = "__id string, __th long, x long, settled boolean, of long, s long, e long"


def _binary(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary())


def _views(column: pa.Array) -> list[np.ndarray]:
    """The values of a binary column as byte arrays (null: empty), without copies."""
    column = _binary(column)
    if not len(column):
        return []
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _mix(*ids: np.ndarray) -> np.ndarray:
    out = np.zeros_like(ids[0])
    for k in ids:
        out = (out ^ k) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def _contexts(buckets, x, lo, hi, length):
    """For anchors: identifiers of the context, and the buckets of the left and the right half (with masks: there is none)."""
    first, last = half_ids(buckets, lo, length), half_ids(buckets, hi, length)
    f = _mix(*first, *last, (x - lo).astype(np.uint64), (hi - lo).astype(np.uint64))
    half = (length - Q) // 2
    end = len(buckets) - 1 + Q
    a = _mix(*half_ids(buckets, np.maximum(x - half, 0), half + Q))
    b = ~_mix(*half_ids(buckets, np.minimum(x, end - (length - half + 1)), length - half + 1))
    no_a, no_b = x - lo < half, x - hi >= half
    a[no_a], b[no_b] = 0, 0
    return f, a, b, no_a, no_b


def _text_anchors(views: list[np.ndarray], length: int):
    """(text, x, lo, hi, h, f, a, b, no a, no b) of all anchors of some texts; positions are the texts' own."""
    out, group, size = [], [], 0

    def flush():
        if not group:
            return
        ends = np.cumsum([len(views[k]) for k in group])
        buckets, text, x, lo, hi = anchors(np.concatenate([views[k] for k in group]), ends, length)
        if len(x):
            begin = np.r_[0, ends[:-1]][text]
            out.append((np.array(group)[text], x - begin, lo - begin, hi - begin, buckets[x], *_contexts(buckets, x, lo, hi, length)))
        group.clear()

    for k, v in enumerate(views):
        if len(v) < length:
            continue
        if len(v) <= PIECE:
            if size + len(v) > CHUNK:
                flush()
                size = 0
            group.append(k)
            size += len(v)
            continue
        for s in range(0, len(v) - Q + 1, PIECE):  # a piece has the anchors in it, with all their windows
            a, b = max(0, s - length), min(len(v), s + PIECE + length)
            buckets, _, x, lo, hi = anchors(v[a:b], np.array([b - a]), length)
            own = (x >= s - a) & (x < s - a + PIECE)
            x, lo, hi = x[own], lo[own], hi[own]
            if len(x):
                out.append((np.full(len(x), k), x + a, lo + a, hi + a, buckets[x], *_contexts(buckets, x, lo, hi, length)))
    flush()
    return out


def _anchor_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, x, lo, hi, h, f, a, b, no_a, no_b in _text_anchors(_views(batch["__t"]), length):
                at = pa.array(text)
                ids = [pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(a.view(np.int64), mask=no_a), pa.array(b.view(np.int64), mask=no_b)]
                columns = [batch["__id"].take(at), batch["__th"].take(at), pa.array(x), pa.array(lo), pa.array(hi), *ids]
                yield pa.RecordBatch.from_arrays(columns, ["__id", "__th", "x", "lo", "hi", "h", "f", "a", "b"])

    return rows


def _body_rows(length: int):
    """Joined rows (text, open runs) to runs with their bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views, lists = _views(batch["__t"]), batch["runs"]
            flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
            doc = np.repeat(np.arange(len(views)), sizes)
            s, e = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("s", "e"))
            for k in range(0, len(doc), RUNS):
                part = slice(k, k + RUNS)
                at = pa.array(doc[part])
                bodies = [views[d][i : j + length].tobytes() for d, i, j in zip(doc[part], s[part], e[part], strict=True)]
                more = [flat.field(c).slice(k, len(bodies)) for c in ("x", "s", "e", "settled")]
                yield pa.RecordBatch.from_arrays([batch["__id"].take(at), batch["__th"].take(at), *more, pa.array(bodies, pa.binary())], ["__id", "__th", "x", "s", "e", "settled", "body"])

    return rows


def _split_rows(length: int, single: bool):
    """Rows (run, body) to rows of shorter runs s to e: identifiers u, v of their bytes and, but for single windows, of the core."""
    width = 1 if single else -(-((length - Q) // 2) // PARTS)

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = _views(batch["body"])
        x, s, e = (batch[c].to_numpy() for c in ("x", "s", "e"))
        sizes = np.array([len(b) for b in bodies])
        # Parts by the anchor's offset in the window: x - e to x - s.
        least, most = (x - e) // width, (x - s) // width
        n = most - least + 1
        of = np.repeat(np.arange(len(n)), n)
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + least[of]
        first, last = np.maximum(x[of] - part * width - (width - 1), s[of]), np.minimum(x[of] - part * width, e[of])
        buckets = qgram_buckets(np.concatenate(bodies))
        shift = (np.cumsum(sizes) - sizes - s)[of]  # from a text's positions to those of the joined bodies
        u, v = half_ids(buckets, first + shift, length)
        columns = {c: batch[c].take(pa.array(of)) for c in ("__id", "__th", "x", "settled")}
        columns |= {"of": pa.array(s[of]), "s": pa.array(first), "e": pa.array(last)}
        if not single:
            place = ((x[of] - first) * 4096 + (last - first)).astype(np.uint64)
            final = half_ids(buckets, last + shift, length)
            u, v = _mix(u, final[0], place), _mix(v, final[1], place)
            # All windows of the part have the bytes from its latest possible start to its earliest possible end.
            core = _mix(*half_ids(buckets, x[of] - part * width + shift, length - width + 1), part.astype(np.uint64))
            columns["core"] = pa.array(core.view(np.int64))
        columns |= {"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))}
        return pa.RecordBatch.from_pydict(columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, RUNS):
                yield split(batch.slice(k, RUNS))

    return rows


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching ones."""
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > reach[:-1]]
    return s[new], reach[np.r_[new[1:], True]]


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, sizes = batch["runs"].flatten(), batch["runs"].value_lengths().to_numpy()
        offsets = np.r_[0, np.cumsum(sizes)]
        starts, ends = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("s", "e"))
        found = [_merged(starts[a:b], ends[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        at = pa.array(np.r_[0, np.cumsum([len(s) for s, _ in found])], pa.int32())
        parts = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (list(x) for x in zip(*found, strict=True))] if found else [pa.array([], pa.int64())] * 2
        lists = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(parts, ["start", "stop"]))
        yield pa.RecordBatch.from_arrays([batch["__id"], batch["__th"], lists], ["__id", "__th", "runs"])


def _kept_rows(names: list[str]):
    """Joined rows (text, removed runs) to the bytes that are left."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lists = [], batch["removed"]
            flat, offsets = lists.flatten(), np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]
            starts, stops = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
            for k, v in enumerate(_views(batch["__t"])):
                a, b = offsets[k], offsets[k + 1]
                gaps = zip([0, *stops[a:b]], [*starts[a:b], len(v)], strict=True)
                kept.append(v.tobytes() if a == b else b"".join(v[i:j].tobytes() for i, j in gaps))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(kept, pa.binary())], [*names, "kept"])

    return rows


def _shared(runs: DataFrame, key: str) -> DataFrame:
    """Buckets of several different contexts, one of which at least isn't known to be repeated."""
    return runs.groupBy(key).agg(F.count(F.lit(1)).alias("m"), F.bool_and("settled").alias("done")).filter("m > 1 AND NOT done").select(key)


def repeated_runs(texts: DataFrame, length: int) -> DataFrame:
    """Byte runs [s, e) of texts (__id, __th, __t) whose windows of ``length`` bytes occur elsewhere too."""
    if length < 2 * Q:
        raise ValueError(f"length must be at least {2 * Q}")
    found = materialise(texts.filter(F.octet_length("__t") >= length).mapInArrow(freeing(_anchor_rows(length)), _ANCHOR), "anchors")
    place = ["__id", "__th", "s", "e"]

    # Level 1: whole contexts (equal ones are repeated), then their halves.
    contexts = found.groupBy("h", "f").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("__id", "__th", "x", "lo", "hi", "a", "b")).alias("r"))
    contexts = materialise(contexts.select("h", "f", (F.col("n") > 1).alias("settled"), "r.*"), "contexts")
    whole = found.join(contexts.filter("settled").select("h", "f"), ["h", "f"]).select("__id", "__th", F.col("lo").alias("s"), F.col("hi").alias("e"))
    whole = materialise(whole, "whole")
    discard(found)
    middle = F.col("x") - (length - Q) // 2
    left = F.struct(F.col("a").alias("core"), F.col("lo").alias("s"), F.least("hi", middle).alias("e"))
    right = F.struct(F.col("b").alias("core"), F.greatest(F.col("lo"), middle + 1).alias("s"), F.col("hi").alias("e"))
    halves = contexts.select("__id", "__th", "x", "settled", F.explode(F.array(left, right)).alias("half")).select("__id", "__th", "x", "settled", "half.*").filter("core IS NOT NULL")
    open_ = halves.join(_shared(halves, "core"), "core").groupBy("__id", "__th").agg(F.collect_list(F.struct("x", "s", "e", "settled")).alias("runs"))
    bodies = materialise(texts.join(open_, ["__id", "__th"]).mapInArrow(freeing(_body_rows(length)), _BODY), "bodies")
    discard(contexts)

    # Level 2: parts of halves.
    parts = materialise(bodies.mapInArrow(freeing(_split_rows(length, single=False)), f"{_PART}, core long, u long, v long"), "parts")
    kinds = parts.groupBy("core", "u", "v").agg(F.count(F.lit(1)).alias("n"), F.bool_or("settled").alias("settled"), F.min(F.struct("__id", "__th", "x", "of", "s", "e")).alias("r"))
    kinds = materialise(kinds.select("core", "u", "v", (F.col("settled") | (F.col("n") > 1)).alias("settled"), "r.*"), "kinds")
    partly = parts.filter("NOT settled").join(kinds.filter("settled").select("u", "v"), ["u", "v"]).select(place)
    open_ = kinds.join(_shared(kinds, "core"), "core").select("__id", "__th", "x", "of", F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("settled").alias("pt"))

    # Level 3: single windows.
    open_ = open_.join(bodies.select("__id", "__th", F.col("s").alias("of"), "body"), ["__id", "__th", "of"])
    body = F.substr("body", F.col("ps") - F.col("of") + 1, F.col("pe") - F.col("ps") + length)
    open_ = open_.select("__id", "__th", "x", F.col("ps").alias("s"), F.col("pe").alias("e"), F.col("pt").alias("settled"), body.alias("body"))
    windows = materialise(open_.mapInArrow(freeing(_split_rows(length, single=True)), f"{_PART}, u long, v long"), "windows")
    several = windows.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u", "v")
    single = windows.filter("NOT settled").join(several, ["u", "v"]).select(place)
    runs = materialise(whole.unionByName(partly).unionByName(single).withColumn("e", F.col("e") + length), "runs")
    discard(whole, bodies, parts, kinds, windows)
    return runs


def _maximal(runs: DataFrame) -> DataFrame:
    """(__id, __th, runs): each text's maximal runs, in order; what ``runs`` was stored in goes."""
    gathered = runs.distinct().groupBy("__id", "__th").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    merged = materialise(gathered.mapInArrow(freeing(_merge_rows), "__id string, __th long, runs array<struct<start:long,stop:long>>"), "spans")
    discard(runs)
    return merged


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, report: int | None = None) -> DataFrame:
    """All columns of ``docs``, and ``kept`` (binary: the text's bytes without the removed ones) and ``removed`` (array of byte runs).

    A byte is removed if a string of ``length`` bytes that covers it also starts
    anywhere else: in another row or at another place of the same one.  Matches
    never cross rows and are judged on the input.  With ``report``, a shorter
    length, there is also ``repeated``: the runs covered by strings of that length
    that occur elsewhere, which stay; only runs of it that have ``length`` bytes are
    searched for the longer strings then.

    Null texts count as empty: kept is empty, removed too; so for texts shorter
    than ``length``.  Rows equal in id and text are occurrences of their own and
    lose what they share.  Ids may be null or repeated.  Any further columns
    pass through; an input column called kept, removed or repeated is replaced.  An
    empty table gives an empty one.
    """
    docs = docs.drop("kept", "removed", "repeated")
    names = docs.columns
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    rows = keyed(docs, id_col, text_col).withColumn("__t", F.col(f"`{text_col}`").cast("string").cast("binary"))
    texts, outs = rows.select("__id", "__th", "__t"), ["removed"]
    if report is None:
        spans = _maximal(repeated_runs(texts, length)).withColumnRenamed("runs", "removed")
    else:
        if report > length:
            raise ValueError("the length to report is the shorter one")
        outs.append("repeated")
        shorter = _maximal(repeated_runs(texts, report))
        # Parts long enough, as texts of their own: keyed by document and place.
        long_runs = shorter.select("__id", "__th", F.filter("runs", lambda r: r["stop"] - r["start"] >= length).alias("long")).filter(F.size("long") > 0)
        parts = texts.join(long_runs, ["__id", "__th"]).select("__id", "__th", "__t", F.explode("long").alias("r"))
        parts = parts.select(F.concat_ws("\0", "__id", F.col("r.start").cast("string")).alias("__id"), "__th", F.substr("__t", F.col("r.start") + 1, F.col("r.stop") - F.col("r.start")).alias("__t"))
        found = repeated_runs(parts, length)
        begin = F.substring_index("__id", "\0", -1)
        moved = found.select(F.expr("substr(__id, 1, length(__id) - length(substring_index(__id, char(0), -1)) - 1)").alias("__id"), "__th", (F.col("s") + begin.cast("long")).alias("s"), (F.col("e") + begin.cast("long")).alias("e"))
        moved = materialise(moved, "moved")
        discard(found)
        spans = shorter.withColumnRenamed("runs", "repeated").join(_maximal(moved).withColumnRenamed("runs", "removed"), ["__id", "__th"], "left")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    joined = rows.join(spans, ["__id", "__th"], "left").select(*[F.col(f"`{c}`") for c in names], *[F.coalesce(c, none).alias(c) for c in outs], "__t")
    keep = [*names, *outs]
    ddl = ", ".join([*kinds, *[f"{c} array<struct<start:long,stop:long>>" for c in outs], "kept binary"])
    return joined.mapInArrow(freeing(_kept_rows(keep)), ddl)
