"""Merkle manifest of a dataset: checkpoint and recompute.

Rows are leaves, in the order of a key inside their group; pairs of nodes become their digest until
one is left, and the roots of the groups, in order, are the leaves of a last tree whose root is the
manifest's. Only every `STEP`-th level is kept, as a Parquet table. A proof is the list of siblings from a leaf to the root:
the levels between two that are kept are computed again from the nodes of an aligned subtree
(2**STEP nodes at most), its siblings are handed to its members, and the levels are dropped again.
Paths are put together from the top down, so the join that brings an upper path to a subtree has a
row per subtree, not per leaf.

No group is gathered: leaves get their places from ranges of the order, subtrees are the only groups,
and a group with most of the rows has most of the subtrees. Whole texts are digested where they are read, once.

A digest is the lowercase hex SHA-256 of what is put in, digests as their hex text. A node without a
neighbour (the last of an odd level) becomes the digest of itself alone. Built-in functions only.

Defined cases: a null field counts as `-`, any other as its bytes, `:`, its text, so null and empty
differ. A null group or key comes first and is a value like any other. Rows with one key are ordered
by their leaves; equal rows are leaves of their own, next to each other. An empty table has no leaves,
no root and no proofs. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmark.llm.ranks import ranked
from hourmark.runtime import cut, new_path, small_side

# Fixed values of the contract: the fields of a leaf in order, and which rows are tampered with.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPER_EVERY = 7
# Parameter: levels from one that is kept to the next.
STEP = 4

PATH = "array<struct<left: boolean, digest: binary>>"


# -- digests --------------------------------------------------------------------


def field_text(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def _above(nodes: Column) -> Column:
    """The next level of an array of digests."""
    pairs = F.slice(F.sequence(F.lit(0), F.size(nodes)), 1, F.shiftright(F.size(nodes) + 1, 1))
    return F.transform(pairs, lambda k: F.sha2(F.concat(F.get(nodes, k * 2), F.coalesce(F.get(nodes, k * 2 + 1), F.lit(""))), 256))


def _steps(n: Column) -> Column:
    """An array of n numbers from 0, n at most STEP."""
    return F.slice(F.array(*map(F.lit, range(STEP))), F.lit(1), n)


def _levels(nodes: Column, n: Column) -> Column:
    """The nodes of a subtree, level by level: those given and the `n` levels above."""
    return F.aggregate(_steps(n), F.array(nodes), lambda made, _: F.concat(made, F.array(_above(F.element_at(made, -1)))))


def _siblings(levels: Column, at: Column, n: Column) -> Column:
    """What stands beside the node `at` of the lowest of these levels and beside its ancestors."""

    def beside(level: Column) -> Column:
        own = F.call_function("shiftright", at, level)
        other = own.bitwiseXOR(F.lit(1))
        return F.struct((other < own).alias("left"), F.unhex(F.get(F.get(levels, level), other)).alias("digest"))

    return F.transform(_steps(n), beside).cast(PATH)


def _text(digest: Column) -> Column:
    """The hex text of a digest that is kept in its 32 bytes."""
    return F.lower(F.hex(digest))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def up(node: Column, s: Column) -> Column:
        beside = F.coalesce(_text(s["digest"]), F.lit(""))
        return F.sha2(F.when(s["left"], F.concat(beside, node)).otherwise(F.concat(node, beside)), 256)

    return F.aggregate(path, leaf, up)


def path_digest(path: Column) -> Column:
    """The digest of the siblings of a path, from the leaf up."""
    return F.sha2(F.array_join(F.filter(F.transform(path, lambda s: _text(s["digest"])), lambda d: d.isNotNull()), ""), 256)


# -- trees ----------------------------------------------------------------------


def height(members: Column) -> Column:
    """Levels above the leaves until one node is left."""
    return F.when(members <= 1, F.lit(0)).otherwise(F.length(F.bin(members - 1)))


def _block(rank: Column) -> Column:
    return F.shiftright(rank, STEP)


def _left_to_fold(level: int) -> Column:
    """Levels from `level` to the next one that is kept, or to the top."""
    return F.least(F.lit(STEP), height(F.col("members")) - F.lit(level))


def _subtrees(nodes: DataFrame, level: int) -> DataFrame:
    """(group, block, members, n, nodes, levels): the nodes of a level by aligned subtree, in order and with
    their other columns, and the digests of these and of the `n` levels above, computed again."""
    own = [c for c in nodes.columns if c not in ("group", "rank", "members")]
    by_block = nodes.where(height(F.col("members")) > level).groupBy("group", "members", _block(F.col("rank")).alias("block"))
    held = by_block.agg(F.sort_array(F.collect_list(F.struct("rank", F.struct(*own).alias("node")))).alias("nodes"))  # 2**STEP at most
    held = held.select("group", "block", "members", _left_to_fold(level).alias("n"), F.col("nodes.node").alias("nodes"))
    return held.withColumn("levels", _levels(F.transform("nodes", lambda x: _text(x["digest"])), F.col("n")))


def kept_levels(leaves: DataFrame) -> list[int]:
    """The levels that are kept of the trees over `leaves`, up to the first at which every root is there."""
    most = leaves.agg(F.max("members")).first()[0] or 0
    return list(range(0, max(0, most - 1).bit_length() + STEP, STEP))


def write_levels(spark: SparkSession, leaves: DataFrame, path: str) -> list[int]:
    """Keep the trees over `leaves`: a folder per kept level with group, rank, members and digest. Returns the
    levels, from the leaves up; the root of a group is the one node of the last level it reaches."""
    kept = kept_levels(leaves)
    nodes = leaves.select("group", "rank", "members", "digest")
    for level in kept:
        if level:
            made = _subtrees(read_level(spark, path, level - STEP), level - STEP)
            top = F.get(F.element_at("levels", -1), F.lit(0))
            nodes = made.select("group", F.col("block").alias("rank"), "members", F.unhex(top).alias("digest"))
        nodes.write.parquet(f"{path}/level={level}")
    return kept


def read_level(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.parquet(f"{path}/level={level}")


def roots(spark: SparkSession, path: str, levels: list[int]) -> DataFrame:
    """(group, root) of every group: its node at the first kept level that has no other."""
    tall = height(F.col("members"))
    first = lambda level: (tall <= level) & ((tall > level - STEP) if level else F.lit(True))
    at = lambda level: read_level(spark, path, level).where(first(level)).select("group", F.col("digest").alias("root"))
    return reduce(DataFrame.unionByName, map(at, levels))


def paths(spark: SparkSession, path: str, levels: list[int], leaves: DataFrame) -> DataFrame:
    """The leaves of kept trees with `path`: the siblings of each up to the root of its group.

    Leaves come with their subtrees, so they are shuffled as they are and never with their paths.
    """
    upper = None
    for level in reversed(levels):
        nodes = read_level(spark, path, level) if level else leaves
        own = [c for c in nodes.columns if c not in ("group", "rank", "members")]
        alone = nodes.where((height(F.col("members")) <= level) & (F.col("rank") == 0)).withColumn("path", F.array().cast(PATH))
        made = _subtrees(nodes, level)
        if upper is None:
            made = made.withColumn("path", F.array().cast(PATH))
        else:
            above = upper.select(F.col("group").alias("__group"), F.col("rank").alias("__block"), "path")
            made = made.join(above, F.col("group").eqNullSafe(F.col("__group")) & (F.col("block") == F.col("__block")))
        beside = F.transform("nodes", lambda x, k: F.struct(k.alias("k"), x.alias("node"), _siblings(F.col("levels"), k, F.col("n")).alias("path")))
        each = made.select("group", "block", "members", F.col("path").alias("upper"), F.explode_outer(beside).alias("m"))
        rank = F.shiftleft("block", STEP) + F.col("m.k")
        steps = F.concat("m.path", "upper").alias("path")
        upper = each.select("group", rank.alias("rank"), "members", *[f"m.node.{c}" for c in own], steps).unionByName(alone)
        upper = cut(upper) if level else upper  # a 2**STEP-th of the level below
    return upper


def manifest(spark: SparkSession, leaves: DataFrame, path: str) -> DataFrame:
    """Write the manifest of `leaves` (group, key, digest in 32 bytes, …) under `path`.

    `path/leaves` and `path/groups` hold the leaves, and the roots of the groups, with their places;
    `path/tree` and `path/top` the kept levels above. Returns one row with the root, null if there is no leaf.
    """
    ranked(cut(leaves), ["group"], ["key", "digest"]).write.parquet(f"{path}/leaves")
    levels = write_levels(spark, spark.read.parquet(f"{path}/leaves"), f"{path}/tree")
    subroots = cut(roots(spark, f"{path}/tree", levels).select(F.lit(0).alias("all"), F.col("group").alias("key"), F.col("root").alias("digest")))
    ranked(subroots, ["all"], ["key", "digest"]).withColumnRenamed("all", "group").write.parquet(f"{path}/groups")
    top = write_levels(spark, spark.read.parquet(f"{path}/groups"), f"{path}/top")
    return roots(spark, f"{path}/top", top).agg(F.max(_text(F.col("root"))).alias("root"))


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """Every leaf of a manifest with all its columns, and subroot, root and path; digests as hex text."""
    leaves, groups = (spark.read.parquet(f"{path}/{name}") for name in ("leaves", "groups"))
    top = kept_levels(groups)
    root = roots(spark, f"{path}/top", top).select(F.col("group"), _text(F.col("root")).alias("root"))
    lasts = paths(spark, f"{path}/top", top, groups).join(root, "group")
    lasts = cut(lasts.select(F.col("key").alias("__group"), _text(F.col("digest")).alias("subroot"), "root", F.col("path").alias("__last")))
    found = paths(spark, f"{path}/tree", kept_levels(leaves), leaves)
    # a group and its last steps meet by the group: one row each, sent to every task while they are few
    joined = found.join(small_side(lasts), F.col("group").eqNullSafe(F.col("__group")))
    own = [c for c in leaves.columns if c not in ("rank", "members", "digest")]
    return joined.select(*own, _text(F.col("digest")).alias("digest"), "subroot", "root", F.concat("path", "__last").alias("path"))


# -- documents ------------------------------------------------------------------


def document_leaves(documents: DataFrame) -> DataFrame:
    """(group, key, digest, tampered) of every document: by language, in order of doc_id. `tampered` is the
    leaf of a document that was tampered with, null for others."""
    changed = {"n_chars": F.col("n_chars") + 1}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    return documents.select(
        F.col("lang").alias("group"),
        F.col("doc_id").alias("key"),
        F.unhex(leaf_digest([F.col(c) for c in FIELDS])).alias("digest"),
        F.when(chosen, F.unhex(leaf_digest([changed.get(c, F.col(c)) for c in FIELDS]))).alias("tampered"),
    )


def judge(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every proof, against tampered documents.

    A document is tampered with where 7 divides the checksum of its id (null ids are left alone): one
    is added to `n_chars`, which changes nothing where that is null.
    """
    spark = documents.sparkSession
    path = new_path(spark, "merkle")
    manifest(spark, document_leaves(documents), path)
    made = proofs(spark, path).withColumn("folded_root", folded(F.coalesce(_text(F.col("tampered")), F.col("digest")), F.col("path")))
    return made.select(
        F.col("key").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        path_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
