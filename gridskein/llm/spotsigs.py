"""Document fingerprints by SpotSigs, in DataFrame operations only.

A signature is a common word (the anchor) with the chain of the next ``CHAIN``
content words, the common words between them skipped; the start of a text is an
anchor too, and the end cuts chains short.  A document is the set of its
signatures; documents are alike by the Jaccard coefficient of their sets.  Two
sets can't be alike by ``least`` unless the smaller has ``least`` times the
larger's length: sets are partitioned by length, each partition meets itself and
the next one, and pairs in it are pruned by length before they are compared.

Scale: signatures are made row by row.  Neighbours in
order of ids meet by spans of ``SPAN`` ids, so a text is shuffled once.  Similar
sets meet under the rarest signatures of their prefix; equal sets are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ._common import discard, materialise

# Common words of some languages, that serve as anchors.
ANCHORS = {
    "en": "the of and to a in is that it for was on with as be by this are at from or an not but have has had were which",
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als auch es an aus",
    "fr": "de la le et les des en un du une que pour est par qui dans avec sur pas au ce il",
    "es": "de la que el en y los se del las un por con no su una para es al lo como más",
    "it": "di che il la per un è non una sono da del con",
    "pt": "de que o a e do da em um para com não uma os no",
}
#: Content words in a chain.
CHAIN = 3
#: A text in which fewer than one word of so many is an anchor takes every word as one.
SPARSE = 32
#: Ids of one span of neighbours.
SPAN = 512
#: Rows that may be broadcast.
SMALL = 50_000

_APART = r"[^a-z0-9_\p{L}\p{M}\p{N}]++"


def common_words() -> list[str]:
    """The anchors of all languages."""
    return sorted({w for words in ANCHORS.values() for w in words.split()})


def with_signatures(df: DataFrame, text: str, name: str = "sigs", anchors: list[str] | None = None, chain: int = CHAIN) -> DataFrame:
    """Add ``name``, the set of the signatures of column ``text``: their 48-bit hashes, ascending; null and texts without words have none.

    Words are runs of letters, marks, digits and underscores, in lower case; what
    separates them doesn't matter.  Columns ``__words``, ``__content`` and
    ``__spots`` are used in between.
    """
    anchors = common_words() if anchors is None else anchors
    lower = F.lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    # Each step is a column of its own, so that none is computed twice.
    df = df.withColumn("__words", F.split(lower, _APART))
    df = df.withColumn("__words", F.filter("__words", lambda w: w != ""))
    df = df.withColumn("__content", F.filter("__words", lambda w: ~w.isin(anchors)))
    n, n_content = F.size("__words"), F.size("__content")
    spots = F.filter(F.transform("__words", lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
    df = df.withColumn("__spots", F.when((n - n_content) * SPARSE >= n, spots))
    # Before the r-th anchor, at place i, lie i - r content words; get() of a place beyond the end is null, and hashes skip nulls.
    common = lambda i, r: F.xxhash64(F.get("__words", i), *[F.get("__content", i - r + k) for k in range(chain)])
    every = lambda w, i: F.xxhash64(w, *[F.get("__words", i + k + 1) for k in range(chain)])
    start = F.array(F.xxhash64(F.lit(""), *[F.get("__content", F.lit(k)) for k in range(chain)]))
    hashed = F.when(n == 0, F.array().cast("array<long>")).when(F.col("__spots").isNull(), F.transform("__words", every)).otherwise(F.concat(start, F.transform("__spots", common)))
    df = df.withColumn(name, F.sort_array(F.array_distinct(F.transform(hashed, lambda h: F.shiftrightunsigned(h, 16)))))
    return df.drop("__words", "__content", "__spots")


def fingerprint(signatures: Column) -> Column:
    """The set as text: 12 hex digits for each signature, ascending; empty for the empty set."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s)), 12, "0")), "")


def with_likeness(df: DataFrame, one: str, other: str, name: str, least: float = 0.0) -> DataFrame:
    """Add ``name``: the Jaccard coefficient of two sets (columns of arrays without repeats); two empty sets are equal.

    0 for sets whose lengths alone keep them under ``least``: they aren't compared.
    Column ``__shared`` is used in between.
    """
    n, m = F.size(one), F.size(other)
    pruned = (F.least(n, m) == 0) | (F.least(n, m) < F.lit(least) * F.greatest(n, m))
    shared = F.when(F.col(one) == F.col(other), n).when(pruned, F.lit(0)).otherwise(F.size(F.array_intersect(one, other)))
    df = df.withColumn("__shared", shared)
    return df.withColumn(name, F.when(n + m == 0, F.lit(1.0)).otherwise(F.col("__shared") / F.greatest(n + m - F.col("__shared"), F.lit(1)))).drop("__shared")


def length_class(n: Column, least: float) -> Column:
    """The partition of a set of ``n`` signatures: bounds grow by 1 / ``least``, so sets that can be alike lie in the same or in neighbouring ones."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / least)) + F.lit(1e-9))).otherwise(-1).cast("int")


def similar_sets(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of ``sets`` (key: long, sigs: array of longs, ascending, no repeats) alike by ``least`` or more, a < b.

    Sets should differ: give one of equal ones.  Of each set the signatures that
    are rarest in all sets meet, as many as a set alike must share one of; they
    meet in the partitions of lengths, where a set looks for those of its own and
    of the next shorter one.  Empty sets pair with none.
    """
    flat = sets.select("key", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    seen = flat.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ordered = flat.join(seen, "sig").groupBy("key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("sigs"))
    needed = F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)).cast("int")
    ordered = ordered.withColumn("part", length_class(F.col("n"), least)).withColumn("prefix", F.slice("sigs", 1, F.col("n") - needed + 1))
    prefix = materialise(ordered.select("key", "n", "part", F.posexplode("prefix").alias("at", "sig")).select("key", "n", "part", "at", "sig.sig"), "prefixes")
    left = prefix.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), "sig", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"))
    right = prefix.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"), "sig", "part")
    longer = (F.col("n_b") < F.col("n_a")) | (F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a"))
    shared = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    # What two sets can share at most from these places on must do for the likeness.
    enough = shared * (1 + least) + 1e-9 >= (F.col("n_a") + F.col("n_b") - F.least("at_a", "at_b")) * F.lit(least)
    fits = (F.col("n_b") + 1e-9 >= F.col("n_a") * F.lit(least)) & enough
    pairs = left.join(right, ["part", "sig"]).filter(longer & fits).select("a", "b").distinct()
    one = sets.select(F.col("key").alias("a"), F.col("sigs").alias("sigs_a"))
    other = sets.select(F.col("key").alias("b"), F.col("sigs").alias("sigs_b"))
    judged = with_likeness(pairs.join(one, "a").join(other, "b"), "sigs_a", "sigs_b", "likeness", least)
    return judged.filter(F.col("likeness") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates among ``docs``: (members, links).

    Members has a row per row: doc_id and class_id, the least doc_id of those with
    the same set of signatures.  Links has pairs (a, b, likeness) of classes alike
    by ``least`` or more.  Texts without words are one class, without links; null
    ids make no class of their own (class_id may be null if nothing else has the set).
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = with_signatures(rows, "text").select("doc_id", "sigs", F.sha2(fingerprint(F.col("sigs")), 256).alias("print"))
    rows = materialise(rows, "spots")
    classes = rows.groupBy("print").agg(F.min("doc_id").alias("class_id"))
    members = rows.select("doc_id", "print").join(classes, "print").select("doc_id", "class_id")
    first = rows.join(classes, "print").filter("doc_id = class_id").dropDuplicates(["print"])
    return members, similar_sets(first.select(F.col("class_id").alias("key"), "sigs"), least)


def with_next(df: DataFrame, id_col: str, tie_col: str, columns: list[str], span: int = SPAN) -> DataFrame:
    """``df`` with ``next_<c>`` for ``columns``: those of the next row in descending order of the whole-number id; after the last row comes the first.

    Null ids come last, equal ids in descending order of ``tie_col`` (not null);
    rows equal in both are each other's neighbours.  A row of an only row's next is
    itself.  Rows meet by spans of ids; the first row of each span goes to the span
    before it as well, found in a table with a row for each span.
    """
    key, tie = F.col(f"`{id_col}`"), F.col(f"`{tie_col}`")
    bottom = -(2**62)
    part = F.coalesce(F.floor(key / span), F.lit(bottom)).cast("long")
    place = F.struct(F.coalesce(key, F.lit(-(2**63))).alias("id"), tie.alias("tie"))
    tops = ranked(df.select(part.alias("part"), place.alias("place")).groupBy("part").agg(F.max("place").alias("place")), "part")
    tops = materialise(tops, "spans")
    n = tops.count()
    upper = tops.select(F.pmod(F.col("rank") - 1, F.lit(max(n, 1))).alias("rank"), F.col("part").alias("to"))
    heads = tops.join(upper, "rank").select("place", "to")
    heads = F.broadcast(heads) if n <= SMALL else heads
    rows = df.select("*", part.alias("__part"), place.alias("__place"))
    rows = rows.join(heads, rows["__place"] == heads["place"], "left").drop("place")
    copies = F.array(F.struct(F.col("__part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("to").alias("part"), F.lit(True).alias("guest")))
    rows = rows.withColumn("__go", F.explode(F.filter(copies, lambda c: c["part"].isNotNull()))).drop("__part", "to")
    down = Window.partitionBy("__go.part").orderBy("__go.guest", F.desc("__place"))
    rows = rows.select("*", *[F.lead(F.col(f"`{c}`")).over(down).alias(f"next_{c}") for c in columns])
    return rows.filter("NOT __go.guest").drop("__go", "__place")


def edited_text(text: Column, following: Column) -> Column:
    """A text whose last half (of its code points, rounded down) is replaced by as many of the following text's first, or all it has."""
    text, following = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike they are.

    One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited (text and edited text) and near_next (text and next text).  Null
    texts are empty.  The order of documents is that of ``with_next``, equal ids by
    their texts; ids are whole numbers.  Other columns are ignored.  An empty
    table gives no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("tie"))
    rows = with_next(with_signatures(rows, "text"), "doc_id", "tie", ["text", "sigs"])
    edited = edited_text(F.col("text"), F.col("next_text"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    rows = with_signatures(rows, "edited", "edited_sigs")
    rows = with_likeness(with_likeness(rows, "sigs", "edited_sigs", "near_edited"), "sigs", "next_sigs", "near_next")
    prints = [fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint")]
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *prints, "near_edited", "near_next")
