"""Merkle manifest of a dataset, with proofs by coordinate lookup.

Every row is a leaf of its group's tree; the groups' roots are the leaves of the
tree above.  A node has coordinates (tree, level, index); the node table is
written once.  To prove a leaf, the coordinates of the siblings it needs are
computed from its index and the size of its group of leaves, exploded, joined
with the node table, put in order and concatenated; with them any leaf can be
folded up to the root.

Scale: levels are made and looked up in tiers of ``TIER``.  In a tier, nodes come
in groups of ARITY ** TIER (729) under one node of the next tier.  Leaves look
up the levels of the first tier, the nodes above them those of the next and so
on, and each passes its proof down, so a node is asked for by at most 486 others,
also near the root of a tree that holds a third of all rows, and the table of
lookups has 12 rows for each leaf at any size.  Indices come from ranges
(``ranked``), so no tree is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ._common import discard, materialise

#: Nodes under one parent, and levels in a tier.
ARITY, TIER = 3, 6
#: Nodes of a tier's lowest level that meet in one node of the next tier.
SPAN = ARITY**TIER
_POWERS = [ARITY**k for k in range(TIER + 1)]
_PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value's part of a leaf: ``-`` for null, else the number of bytes of its text, ``:`` and the text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields one after the other."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _powers(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p).cast("long") for p in _POWERS]), k.cast("int") + 1)


def _parents(digests: Column) -> Column:
    last = F.floor((F.size(digests) - 1) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.array_join(F.slice(digests, i * ARITY + 1, ARITY), ""), 256))


def build_trees(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The node table by tiers, and the roots, of ``leaves`` (tree, index from 0 without gaps, hash).

    Nodes have tree, group, level (in the tier), index (in the level of the tree),
    hash (binary), size (nodes of the group's lowest level) and top (is it the
    tree's root).  Roots have tree, tier and hash (hex).
    """
    tables, rows = [], leaves.select("tree", "index", "hash")
    while not tables or not rows.isEmpty():
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("index", "hash"))), lambda x: x["hash"])
        groups = rows.groupBy("tree", F.floor(F.col("index") / SPAN).alias("group")).agg(in_order.alias("nodes"))
        groups = groups.withColumn("size", F.size("nodes")).withColumn("alone", (F.col("group") == 0) & (F.col("size") < SPAN))

        def climb(levels: Column, _: Column) -> Column:
            last = F.element_at(levels, -1)
            return F.when(F.col("alone") & (F.size(last) < 2), levels).otherwise(F.concat(levels, F.array(_parents(last))))

        levels = F.aggregate(F.sequence(F.lit(1), F.lit(TIER)), F.array(F.col("nodes")), climb)
        made = groups.select("tree", "group", "size", "alone", levels.alias("levels"))
        made = made.select("tree", "group", "size", (F.col("alone") & (F.size("levels") <= TIER)).alias("ends"), F.size("levels").alias("height"), F.posexplode("levels").alias("level", "nodes"))
        made = made.select("tree", "group", "size", "level", (F.col("ends") & (F.col("level") == F.col("height") - 1)).alias("top"), F.posexplode("nodes").alias("at", "hash"))
        index = F.col("group") * _powers(F.lit(TIER) - F.col("level")) + F.col("at")
        table = materialise(made.select("tree", "group", "level", index.alias("index"), F.unhex("hash").alias("hash"), "size", "top"), "nodes")
        tables.append(table)
        rows = table.filter(F.col("level") == TIER).select("tree", F.col("group").alias("index"), F.lower(F.hex("hash")).alias("hash"))
    roots = [t.filter("top").select("tree", F.lit(k).alias("tier"), F.lower(F.hex("hash")).alias("hash")) for k, t in enumerate(tables)]
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return tables, out


def _coordinates(asking: DataFrame) -> DataFrame:
    """(tree, group, index, step, slot, level, sought): where the siblings of each node of a tier lie.

    A node's index in its group and the group's size say which places of each run
    of ARITY are filled and how many levels the group has in this tier.
    """
    alone = (F.col("group") == 0) & (F.col("size") < SPAN)
    within = F.col("index") - F.col("group") * SPAN
    steps = asking.select("tree", "group", "index", "size", alone.alias("alone"), within.alias("within"), F.explode(F.sequence(F.lit(0), F.lit(TIER - 1))).alias("step"))
    width = _powers(F.col("step"))
    steps = steps.withColumn("width", width).filter(~F.col("alone") | (F.col("width") < F.col("size")))
    own = F.floor(F.col("within") / F.col("width"))
    slots = steps.withColumn("own", own).withColumn("slot", F.explode(F.array(*[F.lit(j) for j in range(ARITY)])))
    place = F.floor(F.col("own") / ARITY) * ARITY + F.col("slot")
    slots = slots.withColumn("place", place).filter((F.col("place") != F.col("own")) & (F.col("place") * F.col("width") < F.col("size")))
    sought = F.col("group") * _powers(F.lit(TIER) - F.col("step")) + F.col("place")
    return slots.select("tree", "group", "index", "step", "slot", F.col("step").alias("level"), sought.alias("sought"))


def _tier_proofs(table: DataFrame, asking: DataFrame) -> DataFrame:
    """(tree, group, index, rest, path): the siblings of each asking node (tree, group, index, size, rest) in this tier, by level."""
    nodes = table.filter(F.col("level") < TIER).select("tree", "level", F.col("index").alias("sought"), "hash")
    found = _coordinates(asking).join(nodes, ["tree", "level", "sought"])
    sibling = F.struct("step", "slot", "hash").alias("sibling")
    rest = asking.schema["rest"].dataType
    found = found.select("tree", "group", "index", sibling, F.lit(None).cast("int").alias("size"), F.lit(None).cast(rest).alias("rest"))
    own = asking.select("tree", "group", "index", F.lit(None).cast(found.schema["sibling"].dataType).alias("sibling"), "size", "rest")
    both = found.unionByName(own).repartition("tree", "group")
    rows = both.groupBy("tree", "group", "index").agg(F.array_sort(F.collect_list("sibling")).alias("siblings"), F.max("size").alias("size"), F.first("rest", ignorenulls=True).alias("rest"))
    within = F.col("index") - F.col("group") * SPAN
    alone = (F.col("group") == 0) & (F.col("size") < SPAN)
    height = F.when(alone, F.size(F.filter(F.array(*[F.lit(p) for p in _POWERS[:-1]]), lambda p: p < F.col("size")))).otherwise(TIER)

    def level(step: Column) -> Column:
        slot = F.pmod(F.floor(within / _powers(step)), F.lit(ARITY))
        side = lambda keep: F.array_join(F.transform(F.filter("siblings", lambda s: (s["step"] == step) & keep(s["slot"])), lambda s: F.lower(F.hex(s["hash"]))), "")
        return F.struct(side(lambda s: s < slot).alias("before"), side(lambda s: s > slot).alias("after"))

    path = F.when(height > 0, F.transform(F.sequence(F.lit(0), height - 1), level)).otherwise(F.array().cast(_PATH))
    return rows.select("tree", "group", "index", "rest", path.cast(_PATH).alias("path"))


def look_up_proofs(tables: list[DataFrame], roots: DataFrame, above: DataFrame, leaves: DataFrame) -> DataFrame:
    """The proofs of ``leaves`` (tree, index, rest): tree, index, rest, path and what ``above`` has of its tree.

    ``above`` has a row for each tree: tree, path (what follows the tree's root in a
    proof) and ``top``, a struct that is passed on.  A path lists for each level the
    digests left and right of the proven node, concatenated.
    """
    proofs = None
    ends = roots.select("tree", "tier").join(above.select("tree", "path", "top"), "tree")
    for tier in reversed(range(len(tables))):
        lowest = tables[tier].filter("level = 0").select("tree", "group", "index", "size")
        # A leaf's rest comes along from the first tier's own rows.
        asking = lowest.join(leaves.select("tree", "index", "rest"), ["tree", "index"]) if tier == 0 else lowest.withColumn("rest", F.lit(None).cast("int"))
        mine = _tier_proofs(tables[tier], asking)
        upper = ends.filter(F.col("tier") == tier).select("tree", F.lit(0).cast("long").alias("group"), F.col("path").alias("rise"), "top")
        if proofs is not None:
            upper = upper.unionByName(proofs.select("tree", F.col("index").alias("group"), F.col("path").alias("rise"), "top"))
        proofs = mine.join(upper, ["tree", "group"]).select("tree", "index", "rest", F.concat("path", "rise").alias("path"), "top")
        if tier:
            proofs = materialise(proofs, "proofs")
    return proofs


def siblings_of(path: Column) -> Column:
    """All digests of a path, in order, concatenated."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` has under the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def dataset_manifest(df: DataFrame, id_col: str, group_col: str, columns: list[str], text_col: str, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``df``: id, group, leaf, subroot, root, proof_sha256, path, folded_root and verified.

    A leaf hashes ``columns`` in this order; leaves ascend by id (nulls first,
    equal ids by their digest, rows equal in all in any order) within their group.
    Groups are in bytewise order of their name, null first.  ``folded_root`` is what
    the proof makes of the leaf with ``tampered`` (of ``df``'s columns) in place of
    ``text_col``; without it, of the leaf itself.  ``verified``: it is the root.
    Columns that aren't named are ignored.  A group of one row has its leaf as root;
    an empty table has no rows.
    """
    name = lambda c: F.col(f"`{c}`")
    leaf = leaf_digest(*[name(c) for c in columns])
    changed = name(text_col) if tampered is None else tampered
    other = F.when(changed.eqNullSafe(name(text_col)), F.lit(None)).otherwise(leaf_digest(*[changed if c == text_col else name(c) for c in columns]))
    tree = F.coalesce(F.concat(F.lit("="), name(group_col).cast("string")), F.lit(""))
    rows = df.select(name(id_col).alias("id"), tree.alias("tree"), leaf.alias("hash"), other.alias("other"))
    leaves = materialise(ranked(rows, "id", "hash", within=("tree",), name="index"), "leaves")
    tables, roots = build_trees(leaves)
    tops = materialise(ranked(roots, "tree", name="index"), "subroots")
    upper, peak = build_trees(tops.select(F.lit("").alias("tree"), "index", "hash"))
    summit = peak.select("tree", F.array().cast(_PATH).alias("path"), F.struct(F.col("hash").alias("root")).alias("top"))
    asked = tops.select(F.lit("").alias("tree"), "index", F.struct(F.col("tree").alias("name"), F.col("hash").alias("subroot")).alias("rest"))
    above = look_up_proofs(upper, peak, summit, asked)
    above = materialise(above.select(F.col("rest.name").alias("tree"), "path", F.struct("rest.subroot", "top.root").alias("top")), "above")
    discard(*upper)
    proofs = look_up_proofs(tables, roots, above, leaves.select("tree", "index", F.struct("id", "hash", "other").alias("rest")))
    folded = fold(F.coalesce("rest.other", "rest.hash"), F.col("path"))
    found = proofs.select(
        F.col("rest.id").alias("id"),
        F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1)).alias("group"),
        F.col("rest.hash").alias("leaf"),
        "top.subroot",
        "top.root",
        F.sha2(siblings_of(F.col("path")), 256).alias("proof_sha256"),
        "path",
        folded.alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
