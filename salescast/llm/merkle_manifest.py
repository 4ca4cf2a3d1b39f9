"""Merkle manifest of a dataset: content-addressed records, and proofs by descent from the root.

A leaf is the SHA-256 of a row's fields, each ``-`` if null and else its UTF-8 byte count,
``:`` and the value; all digests are lower-case hex text, and a node is the SHA-256 of its
children's digests one after the other. Leaves of a source ascend by doc_id (null first,
then by digest). Every ``FAN`` consecutive nodes become one, until one is left: the
source's subroot. The subroots, ordered by source (null first, bytewise), likewise give
the root.

Ranks are found without sorting a source in one task: rows are dealt by range, counted
per source and range, and numbered within each. ``LEVELS`` levels at a time are hashed
from an array of at most ``FAN ** LEVELS`` digests, the only group there is. Its result,
a *pack*, holds the digest-to-children records of those levels and is stored under the
digest of its top; equal packs are one record, wherever they occur.

Proofs descend from the root. Requests (source and rank) that share a way go down it as
one row: each step joins the way's digest with the packs, picks children by the digits of
the rank and collects the children not picked. The last step opens to the requested
leaves. The path, collected from the root, is reversed for folding a leaf up.

Equal rows are leaves of their own with equal digests. A null text is a leaf field like
any other, and has no line ends to lose. Very long texts are hashed whole. A lone leaf is
its own subroot and may be the root, with the proof of no sibling (the digest of no
bytes). An empty table has no rows and no root. Columns other than the five hashed ones
are ignored. Built-in DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salescast.llm.scratch import stored
from salescast.session import shuffle_partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
LEVELS = 5


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def field(value: Column) -> Column:
    """A field as it is hashed."""
    told = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(value) for value in values]))


def leaves(docs: DataFrame) -> DataFrame:
    """row_no, doc_id, source, leaf and, for rows that are tampered with, tampered.

    Tampering deletes the line ends of the text of every row whose crc32 of doc_id is even.
    """
    doc_id = F.col("doc_id").cast("long")
    others = [F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    is_tampered = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
    changed = leaf(doc_id, *others, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        doc_id.alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf(doc_id, *others, F.col("text")).alias("leaf"),
        F.when(is_tampered & F.contains("text", F.lit("\n")), changed).alias("tampered"),
    )


def ranked(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their rank (from 0) in ``order`` within each ``tree``, and the tree's size.

    Dealt by range and stored, so that a range keeps its rows. No window spans more than
    one range of one tree, or the ranges of a tree.
    """
    keys = [F.col(c).asc_nulls_first() for c in [tree, *order]]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()), name)
    counts = dealt.groupBy(tree, "part").agg(F.count("*").alias("rows"))
    parts = Window.partitionBy(tree)
    before = F.sum("rows").over(parts.orderBy("part")) - F.col("rows")
    counts = counts.select(
        F.col(tree).alias("_tree"), F.col("part").alias("_part"), before.alias("before"), F.sum("rows").over(parts).alias("size")
    )
    numbered = dealt.withColumn("place", F.row_number().over(Window.partitionBy(tree, "part").orderBy(*keys[1:])))
    same = F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("part") == F.col("_part"))
    found = numbered.join(counts, same).withColumn("rank", F.col("before") + F.col("place") - 1)
    return found.drop("_tree", "_part", "part", "before", "place")


def _height(size: Column) -> Column:
    """Levels of a pack of a tree with ``size`` nodes left: as many as it takes to one node, ``LEVELS`` at most."""
    enough = F.lit(LEVELS)
    for levels in range(LEVELS - 1, -1, -1):
        enough = F.when(size <= FAN**levels, F.lit(levels)).otherwise(enough)
    return enough


def _above(nodes: Column) -> Column:
    """The parents of a level."""
    first = F.sequence(F.lit(1), F.size(nodes), F.lit(FAN))
    return F.transform(first, lambda at: digest(F.array_join(F.slice(nodes, at, F.lit(FAN)), "")))


def packs_of(nodes: DataFrame) -> DataFrame:
    """Packs of nodes: tree, rank and size (of the level above the packs), top, levels.

    ``nodes`` has tree, rank, size and digest. ``levels`` are arrays of digests, from the
    nodes themselves to those below the top.
    """
    width = FAN**LEVELS
    bottom = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda n: n["digest"])
    groups = nodes.withColumn("pack", F.floor(F.col("rank") / width)).groupBy("tree", "pack")
    found = groups.agg(bottom.alias("nodes"), F.max("size").alias("size"))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.col("nodes").alias("now"))
    climb = F.aggregate(
        F.sequence(F.lit(1), _height(F.col("size"))),
        start,
        lambda s, _: F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), _above(s["now"]).alias("now")),
    )
    found = found.withColumn("climb", climb)
    size = F.ceil(F.col("size") / width).alias("size")
    return found.select("tree", F.col("pack").alias("rank"), size, F.col("climb.now")[0].alias("top"), F.col("climb.done").alias("levels"))


def build(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Trees (tree, digest of the top, steps down to its nodes) and the store of packs (top, levels).

    ``nodes`` has tree, rank, size and digest. A tree of one node has no pack and no step.
    """
    nodes = nodes.select("tree", "rank", "size", "digest")
    trees, packs, step = nodes.where("size = 1").select("tree", "digest", F.lit(0).alias("steps")), None, 0
    nodes = nodes.where("size > 1")
    while packs is None or not nodes.isEmpty():
        step += 1
        found = stored(packs_of(nodes), f"{name}-packs")
        packs = found if packs is None else packs.union(found)
        above = found.select("tree", "rank", "size", F.col("top").alias("digest"))
        trees = trees.union(above.where("size = 1").select("tree", "digest", F.lit(step).alias("steps")))
        nodes = above.where("size > 1")
    # Packs of the same content have the same address.
    return trees, stored(packs.select("top", "levels").dropDuplicates(["top"]), f"{name}-store")


def records(packs: DataFrame) -> DataFrame:
    """The digest-to-children records of packs: digest, children. Each digest is there once."""
    opened = packs.select("levels", F.posexplode("levels").alias("level", "nodes"), "top")
    above = F.coalesce(F.get("levels", F.col("level") + 1), F.array("top"))
    child = lambda n, i: F.struct(n.alias("digest"), F.slice("nodes", FAN * i + 1, F.lit(FAN)).alias("children"))
    return opened.select(F.explode(F.transform(above, child)).alias("r")).select("r.*").dropDuplicates(["digest"])


def _segment(levels: Column, place: Column) -> Column:
    """The way down a pack to a place of its lowest level: per level the children left and right of the one picked."""

    def step(level: Column) -> Column:
        nodes = F.element_at(levels, (level + 1).cast("int"))
        at = F.floor(place / F.pow(F.lit(FAN), level)).cast("int")
        digit = at % FAN
        left = F.array_join(F.slice(nodes, at - digit + 1, digit), "")
        right = F.array_join(F.slice(nodes, at + 2, F.lit(FAN - 1) - digit), "")
        return F.struct(left.alias("left"), right.alias("right"))

    no_step = F.array().cast(_PATH)
    return F.when(F.size(levels) == 0, no_step).otherwise(F.transform(F.sequence(F.size(levels) - 1, F.lit(0), F.lit(-1)), step))


_PATH = "array<struct<left: string, right: string>>"


def descend(ways: DataFrame, packs: DataFrame, requests: DataFrame, name: str) -> DataFrame:
    """``requests`` (tree, rank) with the columns of their tree's way, and its path from the root.

    ``ways`` has tree, digest, steps and path: where each tree begins and how it was
    reached. Its other columns are passed down.
    """
    width = FAN**LEVELS
    passed = [c for c in ways.columns if c not in ("tree", "digest", "steps", "path")]
    pack = F.floor(F.col("rank") / width)
    asked = stored(requests.select("tree", pack.alias("rank")).distinct(), f"{name}-asked")

    def begin(steps: int) -> DataFrame:
        rank = F.lit(0).cast("long").alias("rank")
        return ways.where(F.col("steps") == steps).select("tree", rank, "digest", "path", *passed)

    reached = begin(0).drop("digest").withColumn("levels", F.array().cast("array<array<string>>"))
    deepest = ways.agg(F.max("steps")).first()[0] or 0
    here = None
    for step in range(deepest, 0, -1):
        here = begin(step) if here is None else here.unionByName(begin(step))
        # Ways that nobody asked for are left.
        prefix = F.floor(F.col("rank") / width ** (step - 1)).alias("_rank")
        wanted = asked.select(F.col("tree").alias("_tree"), prefix).distinct()
        here = here.join(wanted, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("rank") == F.col("_rank")), "left_semi")
        here = here.join(packs, F.col("digest") == F.col("top")).drop("top", "digest")
        if step > 1:
            here = here.select("*", F.posexplode(F.element_at("levels", 1)).alias("place", "digest")).select(
                "tree",
                (F.col("rank") * width + F.col("place")).alias("rank"),
                "digest",
                F.concat("path", _segment(F.col("levels"), F.col("place"))).alias("path"),
                *passed,
            )
            here = stored(here, f"{name}-ways")
    if here is not None:
        reached = reached.unionByName(here)
    reached = reached.withColumnsRenamed({"tree": "_tree", "rank": "_pack"})
    found = requests.join(reached, F.col("tree").eqNullSafe(F.col("_tree")) & (pack == F.col("_pack")))
    path = F.concat("path", _segment(F.col("levels"), F.col("rank") - F.col("_pack") * width))
    return found.withColumn("path", path).drop("_tree", "_pack", "levels")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path (from the leaf up) lead to."""
    return F.aggregate(path, start, lambda below, step: digest(F.concat(step["left"], below, step["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """Every row's place and proof: row_no, doc_id, source, rank, leaf, tampered, subroot, root, path (from the leaf up)."""
    rows = stored(leaves(docs), "merkle-leaves")
    rows = stored(ranked(rows, "source", ["doc_id", "leaf", "row_no"], "merkle-dealt"), "merkle-ranked")
    trees, packs = build(rows.select(F.col("source").alias("tree"), "rank", "size", F.col("leaf").alias("digest")), "merkle")
    trees = trees.select(F.lit(0).alias("whole"), F.col("tree").alias("source"), F.col("digest").alias("subroot"), "steps")
    trees = stored(ranked(stored(trees, "merkle-trees"), "whole", ["source"], "merkle-sources"), "merkle-subroots")
    trees = trees.withColumnRenamed("whole", "tree")

    tops, top_packs = build(trees.select("tree", "rank", "size", F.col("subroot").alias("digest")), "merkle-top")
    tops = tops.select("tree", "digest", F.col("digest").alias("root"), "steps", F.array().cast(_PATH).alias("path"))
    ways = descend(tops, top_packs, trees.select("tree", "rank", "source", "subroot", F.col("steps").alias("below")), "merkle-top")
    ways = ways.select(
        F.col("source").alias("tree"), F.col("subroot").alias("digest"), F.col("below").alias("steps"), "path", "subroot", "root"
    )
    requests = rows.select(F.col("source").alias("tree"), "rank", "row_no", "doc_id", "leaf", "tampered")
    found = descend(stored(ways, "merkle-top-ways"), packs, requests, "merkle")
    return found.withColumnRenamed("tree", "source").withColumn("path", F.reverse("path"))


def verified_leaves(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    found = manifest(docs)
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    found = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return found.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", verified)
