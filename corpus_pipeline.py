"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept; all but the last return the columns of ``docs``, whatever their names:
a column called like one of an operator's results passes through unchanged.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridskein.llm._common import keyed, materialise, table
from gridskein.llm.decontamination import without_contaminated
from gridskein.llm.language_id import fit_language_model, identify_languages
from gridskein.llm.packing import pack_documents
from gridskein.llm.queries import tokenizer_path
from gridskein.llm.simhash_dedup import simhash_components
from gridskein.llm.suffix_dedup import suffix_dedup
from gridskein.storage import setting


#: Bytes of a repeated passage that is cut: 51 words of the documents have 245 or more in 99 of 100 places, and repetitive texts fewer.
PASSAGE = 200

#: Bytes of a batch that a stage hands to Python; Spark's own bound is 64 MB, twice a task's share of the texts.
BATCH = 4 << 20

_USED = ("doc_id", "text", "lang")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with names that can't clash for all columns but those that operators use, and a function that puts the names (and new values) back."""
    names = docs.columns
    own = [c if c in _USED else f"__own{k}" for k, c in enumerate(names)]

    def back(df: DataFrame, **new) -> DataFrame:
        return df.select(*[new.get(c, F.col(o)).alias(c) for o, c in zip(own, names, strict=True)])

    return docs.toDF(*own), back


def _in_small_batches(stage: Stage) -> Stage:
    """The stage, with batches of about ``BATCH`` bytes at most in all that it runs: a batch is held by the JVM and several times over by Python."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH)):
            return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any language (``und``: null texts, texts without letters) go; repeated rows stay or go together.

    Of languages with equal scores the one that comes first by name is taken, which decides no row's fate.
    """
    docs, back = _apart(docs)
    return back(identify_languages(docs, fit_language_model(docs)).filter("lang_pred <> 'und'"))


@_in_small_batches
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the least doc_id stays.

    Of ties, rows equal in doc_id and text, any one stays.  Null and empty texts
    have equal fingerprints and are copies of each other; a null doc_id comes last.
    """
    docs, back = _apart(docs)
    rows = simhash_components(docs.select("doc_id", "text"))
    stay = rows.filter("__id = first_id AND __th = first_th").select("__id", "__th").distinct()
    kept = keyed(docs, "doc_id", "text").join(stay, ["__id", "__th"], "left_semi")
    return back(kept.dropDuplicates(["__id", "__th"]))


@_in_small_batches
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by strings of ``PASSAGE`` bytes that occur elsewhere go; no document goes.

    Characters broken at a cut become U+FFFD.  ``n_chars``, if there is such a
    column, counts what is left of a text that was cut.  Null texts stay null.
    """
    names, (docs, back) = docs.columns, _apart(docs)
    found = suffix_dedup(docs, length=PASSAGE)
    cut = F.size("removed") > 0
    text = F.when(cut, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in names:
        own = docs.columns[names.index("n_chars")]
        new["n_chars"] = F.when(cut, F.length(text)).otherwise(F.col(own)).cast(docs.schema[own].dataType)
    return back(found, **new)


@_in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item in five tokens or more, or are nothing but a shorter one, go; null and empty texts stay.

    Rows that repeat id and text stay or go together, and so do equal texts under other ids.
    """
    docs, back = _apart(docs)
    return back(without_contaminated(docs, table(spark, sf_dir, "benchmark")))


@_in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 2048 tokens: a row for each piece.

    Null and empty texts are one piece of the closing id; every row is packed,
    repeated ones and those without an id too.  Pieces of equal length are
    interchangeable, so which of them share a sequence is left open.  Columns
    other than id and text are ignored; an empty table gives no rows.
    """
    return pack_documents(docs, tokenizer_path(), capacity=2048, ranks=tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_dedup", keep_one_of_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH)):
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
