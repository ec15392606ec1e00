"""Language identification of whole texts and of spans of mixed texts.

Method: the script of a word (by code point ranges) narrows the candidate
languages; a word's score under a candidate is the log-likelihood of its letter
trigrams; Viterbi over a text's words with a penalty for each switch labels
spans.  A text's language is the one whose spans hold most letters.

Scale: the trigram model is fitted on a bounded sample of labelled rows
(``bound`` documents of a language, spread by hash over the whole table) and has
a fixed size for each language;
labelling is one scan without a shuffle, in numpy, many texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import freeing, groups_of

#: Trigram buckets (a power of two), documents to fit on (of a language), cost of a switch in nats, bytes labelled side by side (a longer text is taken alone) and code points scored at a time.
BUCKETS = 1 << 16
BOUND = 20_000
PENALTY = 10.0
LABELLED = 3 << 20
CODE_POINTS = 1 << 18

#: First and last code point of scripts (Unicode block ranges); 0 is every other one.
SCRIPTS = (
    (0x0041, 0x024F), (0x1E00, 0x1EFF),  # Latin
    (0x0370, 0x03FF), (0x1F00, 0x1FFF),  # Greek
    (0x0400, 0x052F),  # Cyrillic
    (0x0530, 0x058F),  # Armenian
    (0x0590, 0x05FF),  # Hebrew
    (0x0600, 0x077F),  # Arabic
    (0x0900, 0x097F),  # Devanagari
    (0x0980, 0x09FF),  # Bengali
    (0x0A00, 0x0A7F),  # Gurmukhi
    (0x0A80, 0x0AFF),  # Gujarati
    (0x0B80, 0x0BFF),  # Tamil
    (0x0C00, 0x0C7F),  # Telugu
    (0x0C80, 0x0CFF),  # Kannada
    (0x0D00, 0x0D7F),  # Malayalam
    (0x0E00, 0x0E7F),  # Thai
    (0x10A0, 0x10FF),  # Georgian
    (0x1100, 0x11FF), (0xAC00, 0xD7AF),  # Hangul
    (0x3040, 0x30FF),  # Kana
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF),  # Han
)

_TABLES: list = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, its lower case, its script."""
    if not _TABLES:
        every = range(0x110000)
        letter = np.fromiter((chr(k).isalpha() for k in every), bool, len(every))
        lower = np.arange(len(every), dtype=np.uint32)
        for k in np.flatnonzero(letter).tolist():
            low = chr(k).lower()
            if len(low) == 1:
                lower[k] = ord(low)
        script = np.zeros(len(every), np.uint8)
        for k, (first, last) in enumerate(SCRIPTS):
            script[first : last + 1] = k + 1
        _TABLES.append((letter, lower, script))
    return _TABLES[0]


def _words(texts: list[str]):
    """Words (runs of letters) of some texts: their text, start, stop, script; and their letters' trigram buckets."""
    letter, lower, script = _tables()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([0, *map(len, texts)])
    good = letter[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[begins] = True  # a word ends with its text
    first = np.flatnonzero(good & np.r_[True, ~good[:-1] | edge[1:-1]][: len(good)])
    last = np.flatnonzero(good & np.r_[~good[1:] | edge[1:-1], True][-len(good) :]) + 1 if len(good) else first
    at = np.flatnonzero(good)
    low = np.where(good, lower[points], 0).astype(np.uint64)
    size = last - first
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    one = np.where(place > 0, low[at - 1], 0).astype(np.uint64)
    two = np.where(place > 1, low[np.maximum(at, 2) - 2], 0).astype(np.uint64)
    h = (low[at] * np.uint64(0x9E3779B97F4A7C15) + one * np.uint64(0xC2B2AE3D27D4EB4F) + two * np.uint64(0x165667B19E3779F9)) >> np.uint64(20)
    buckets = ((h ^ (h >> np.uint64(23))) & np.uint64(BUCKETS - 1)).astype(np.int64)
    text = np.searchsorted(begins, first, side="right") - 1
    return text, first - begins[text], last - begins[text], script[points[first]], buckets


def _parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about CODE_POINTS together, with the place of the first."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CODE_POINTS:
            yield begin, texts[begin : k + 1]
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


@dataclass(frozen=True)
class LanguageModel:
    """Languages, log-likelihoods of trigram buckets by language, and which languages use a script."""

    languages: list[str]
    weights: np.ndarray
    uses: np.ndarray


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    size = BUCKETS + len(SCRIPTS) + 1
    for batch in batches:
        langs, texts = np.array(batch["lang"].to_pylist(), object), batch["text"].to_pylist()
        for lang in set(langs.tolist()):
            own = [texts[k] for k in np.flatnonzero(langs == lang)]
            total = counts.setdefault(lang, np.zeros(size, np.int64))
            for _, part in _parts(own):
                _, first, last, script, buckets = _words(part)
                total[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(script, last - first, minlength=size - BUCKETS).astype(np.int64)
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = BOUND) -> LanguageModel:
    """Fit on about ``bound`` rows of each language, chosen by a hash of id and text (all of a language's rows if they are fewer).

    Rows without text or language teach nothing.  The counts that reach the driver
    are bounded by the number of languages and buckets.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > bound)
    shares = {r["lang"]: int(bound / r["m"] * (1 << 30)) for r in sizes.collect()}  # languages, not rows
    if shares:
        limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("lang")), F.lit(1 << 30))
        rows = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < limit)
    counted = rows.select("text", "lang").mapInArrow(freeing(_count_rows), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counted["lang"]))
    table = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    for k, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        table[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    weights = np.log((grams + 0.2) / (grams.sum(axis=0) + 0.2 * BUCKETS)).astype(np.float32)
    return LanguageModel(languages, weights, scripts >= 0.01 * np.maximum(1, scripts.sum(axis=0)))


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each word of many texts at once; ``sizes`` are the texts' words, ``scores`` theirs in turn."""
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    begin, ends = begin[order], sizes[order]
    longest = int(ends[0]) if len(ends) else 0
    running = len(ends) - np.searchsorted(ends[::-1], np.arange(longest), side="right")
    came = np.empty(len(scores), np.int16)  # the best state before this word
    stays = np.empty(scores.shape, bool)
    value = np.zeros((len(ends), scores.shape[1]), np.float32)
    final = np.zeros(len(ends), np.int64)
    for t in range(longest):
        n = running[t]
        at = begin[:n] + t
        if t:
            final[n : running[t - 1]] = value[n : running[t - 1]].argmax(axis=1)
        now = value[:n]
        best = now.argmax(axis=1)
        other = now[np.arange(n), best] - penalty
        came[at] = best
        stays[at] = now >= other[:, None]
        np.maximum(now, other[:, None], out=now)
        now += scores[at]
    if longest:
        final[: running[-1]] = value[: running[-1]].argmax(axis=1)
    states = np.empty(len(scores), np.int16)
    for t in range(longest - 1, -1, -1):
        n = running[t]
        at = begin[:n] + t
        here = final[:n]
        states[at] = here
        final[:n] = np.where(stays[at, here], here, came[at])
    return states


def label_texts(texts: list[str | None], model: LanguageModel, penalty: float = PENALTY):
    """(language, score, spans) of each text; spans are (start, stop, language) in code points."""
    plain = [t or "" for t in texts]
    names, shares = ["und"] * len(texts), np.zeros(len(texts))
    spans: list[list] = [[] for _ in texts]
    if not model.languages:
        return names, shares, spans
    parts = []
    for begin, part in _parts(plain):
        text, first, last, script, buckets = _words(part)
        if len(first):
            size = last - first
            score = np.add.reduceat(model.weights[buckets], np.cumsum(size) - size, axis=0)
            fits = model.uses[script]
            some = fits.any(axis=1, keepdims=True)
            score = np.where(some, np.where(fits, score, score.min(axis=1, keepdims=True) - 50), 0)
            parts.append((text + begin, first, last, score, some[:, 0]))
    if not parts:
        return names, shares, spans
    text, first, last, score, some = (np.concatenate(c) for c in zip(*parts, strict=True))
    states = viterbi(score.astype(np.float32), np.bincount(text, minlength=len(texts)), penalty)
    k = len(model.languages)
    letters = np.bincount(text * k + states, last - first, minlength=len(texts) * k).reshape(-1, k)
    known = np.bincount(text * k + states, (last - first) * some, minlength=len(texts) * k).reshape(-1, k)
    best = letters.argmax(axis=1)
    total = letters.sum(axis=1)
    for i in np.flatnonzero(total):
        names[i] = model.languages[best[i]]
    shares = known[np.arange(len(texts)), best] / np.maximum(1, total)
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (states[1:] != states[:-1])])
    final = np.r_[new[1:] - 1, len(text) - 1]
    for i, a, b, s in zip(text[new].tolist(), first[new].tolist(), last[final].tolist(), states[new].tolist(), strict=True):
        spans[i].append({"start": a, "stop": b, "lang": model.languages[s]})
    return names, shares, spans


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """All columns of ``docs``, and lang_pred, lang_score (0 to 1) and lang_spans (array of start, stop, lang; in code points).

    lang_pred is a language of the model, or ``und`` (score 0, no spans) if the
    text is null or has no letter, or the model knows no language.  The score is
    the share of letters in spans of lang_pred, without words in scripts that no
    language of the model uses.  Ties go to the language first in order.  Input
    columns with those names are replaced; rows may repeat; an empty table gives
    an empty one.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_spans")
    names = docs.columns
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))
    column = text_col if docs.schema[text_col].dataType.simpleString() == "string" else "__t"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole[column]), 0).to_numpy(zero_copy_only=False)
            for a, b in groups_of(sizes + 1, LABELLED):
                batch = whole.slice(a, b - a)
                found, shares, spans = label_texts(batch[column].to_pylist(), model, penalty)
                columns = [batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, span)], [*names, "lang_pred", "lang_score", "lang_spans"])

    texts = docs if column == text_col else docs.withColumn("__t", F.col(f"`{text_col}`").cast("string"))
    return texts.mapInArrow(freeing(rows), ", ".join([*kinds, "lang_pred string, lang_score double, lang_spans array<struct<start:int,stop:int,lang:string>>"]))
