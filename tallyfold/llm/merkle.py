"""Merkle manifest of a dataset, and proofs by descent of its content-addressed records.

A row's leaf is the digest of its fields.  The leaves of a tree (a source) stand in order of their id; while there are
several nodes, every FAN consecutive ones become the digest of their digests.  The trees' roots, in order of
the trees, are joined the same way.  A stored record names, by the digest of a subtree of SPAN levels, that
subtree's children.  Leaf requests descend from the root: their rank, in digits of FAN, says which child each level
takes; the children not taken are collected, and the path segments, reversed, lead from leaf to root.

Requests under one record descend as one row until they part, so a record is looked up once for each place where
it stands; rows of one source are spread over blocks of FAN ** SPAN leaves.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import shared_dir, staged

FAN, SPAN = 3, 5
BLOCK = FAN**SPAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<l string, r string>>"


def encoded(value: Column) -> Column:
    """`-` for null, else byte count, colon, value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def tree_name(col: str) -> Column:
    """A name that is never null and sorts as the values do, null first."""
    return F.coalesce(F.concat(F.lit("s"), F.col(col).cast("string")), F.lit(""))


def height(n: Column) -> Column:
    """Levels above n nodes, up to SPAN of them."""
    return F.size(F.filter(F.array(*(F.lit(FAN**k) for k in range(SPAN))), lambda p: p < n))


def _joined(nodes: Column) -> Column:
    """The level above an array of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda k: F.sha2(F.concat(*(_digest_at(nodes, k * FAN + i) for i in range(FAN))), 256))


def _digest_at(nodes: Column, at: Column) -> Column:
    return F.coalesce(F.get(nodes, at), F.lit(""))


def levels(children: Column, height: Column) -> Column:
    """All levels over `children`, themselves first."""
    up = F.aggregate(F.sequence(F.lit(1), height), F.array(children), lambda a, _: F.array_append(a, _joined(F.element_at(a, -1))))
    return F.when(height > 0, up).otherwise(F.array(children))


def segment(levels: Column, height: Column, digits: Column) -> Column:
    """From the record's root down to child number `digits`: at each level what stands left and right in the same run."""

    powers = F.array(*(F.lit(FAN**i) for i in range(SPAN)))

    def step(k: Column) -> Column:
        q = F.floor(digits / F.element_at(powers, k)).cast("int")
        return F.struct(F.element_at(levels, k).alias("nodes"), q.alias("q"), (q % FAN).alias("turn"))

    def beside(x: Column) -> Column:
        sibling = lambda i: _digest_at(x["nodes"], x["q"] - x["turn"] + i)
        left = F.concat(*(F.when(x["turn"] > i, sibling(i)).otherwise("") for i in range(FAN - 1)))
        right = F.concat(*(F.when(x["turn"] < i, sibling(i)).otherwise("") for i in range(1, FAN)))
        return F.struct(left.alias("l"), right.alias("r"))

    taken = F.transform(F.transform(F.sequence(height, F.lit(1)), step), beside)
    return F.when(height > 0, taken).otherwise(F.array().cast(_PATH))


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """`rows` with pos, their place in their tree from 0 on, and n, the rows of that tree.

    A range sort over tree and order places every row, so a large tree takes as many tasks as its rows need; rows that are equal
    throughout are told apart by where they were read.
    """
    keys = [tree, *order, "_read"]
    sorted_ = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    written = staged(sorted_.drop("_read").withColumn("_row", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_row", 33))
    counts = written.groupBy(tree, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = W.Window.partitionBy(tree).orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = counts.select(
        tree, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(W.Window.partitionBy(tree)).alias("n")
    )
    return written.join(offsets, [tree, "_part"]).withColumn("pos", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


@dataclasses.dataclass(frozen=True)
class Manifest:
    """Tables below one folder: leaves (tree, pos, n, id, leaf, ...), records of each stage, and the root (None: no rows)."""

    spark: SparkSession
    path: str
    root: str | None
    tree_stages: int
    top_stages: int

    def leaves(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/leaves")

    def records(self, kind: str, stage: int) -> DataFrame:
        """tree, block, n, height, children, digest."""
        return self.spark.read.parquet(f"{self.path}/{kind}-{stage}")

    def subroots(self) -> DataFrame:
        """tree, digest, stage (of the record that it names)."""
        return _tops([self.records("trees", k) for k in range(self.tree_stages)])


def _tops(stages: list[DataFrame]) -> DataFrame:
    out = None
    for k, records in enumerate(stages):
        top = records.where(F.col("n") <= BLOCK).select("tree", "digest", F.lit(k).alias("stage"))
        out = top if out is None else out.union(top)
    return out


def _build(nodes: DataFrame, path: str, kind: str) -> int:
    """Write the records over (tree, pos, n, digest), stage by stage; how many stages there are."""
    spark, stage = nodes.sparkSession, 0
    while True:
        block = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
        children = F.transform(F.sort_array(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        records = nodes.groupBy("tree", block, "n").agg(children.alias("children")).withColumn("height", height(F.col("n")))
        top = F.element_at(F.element_at(levels(F.col("children"), F.col("height")), -1), 1)
        records.select("tree", "block", "n", "height", "children", top.alias("digest")).write.parquet(f"{path}/{kind}-{stage}")
        records, stage = spark.read.parquet(f"{path}/{kind}-{stage}"), stage + 1
        nodes = records.where(F.col("n") > BLOCK).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), "digest")
        if nodes.isEmpty():
            return stage


def build_manifest(leaves: DataFrame, path: str | None = None) -> Manifest:
    """The manifest of (tree, id, leaf, ...), written below `path` (default: the shared folder); more columns stay with the leaves.

    Rows with null ids come first in their tree, rows that repeat an id stand in order of their leaves; an empty table has no root.
    """
    spark = leaves.sparkSession
    path = path or f"{shared_dir(spark)}/tallyfold/manifest-{uuid.uuid4().hex}"
    numbered(leaves, "tree", ["id", "leaf"]).write.parquet(f"{path}/leaves")
    rows = spark.read.parquet(f"{path}/leaves")
    tree_stages = _build(rows.select("tree", "pos", "n", F.col("leaf").alias("digest")), path, "trees")
    made = Manifest(spark, path, None, tree_stages, 0)
    roots = numbered(made.subroots().withColumn("top", F.lit("")), "top", ["tree"])
    roots.select(F.col("top").alias("tree"), "pos", "n", "digest", F.col("tree").alias("name"), "stage").write.parquet(f"{path}/subroots")
    top_stages = _build(spark.read.parquet(f"{path}/subroots").select("tree", "pos", "n", "digest"), path, "top")
    top = _tops([made.records("top", k) for k in range(top_stages)]).collect()  # one row, or none
    root = top[0]["digest"] if top else None
    spark.createDataFrame([(root, tree_stages, top_stages)], "root string, tree_stages int, top_stages int").coalesce(1).write.parquet(f"{path}/summary")
    return dataclasses.replace(made, root=root, top_stages=top_stages)


def load_manifest(spark: SparkSession, path: str) -> Manifest:
    row = spark.read.parquet(f"{path}/summary").first()
    return Manifest(spark, path, row["root"], row["tree_stages"], row["top_stages"])


def _addressed(records: DataFrame) -> DataFrame:
    """digest -> height and levels; equal subtrees are one record."""
    return records.select("digest", "height", levels(F.col("children"), F.col("height")).alias("levels")).dropDuplicates(["digest"])


def _step(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """(tree, block, digest, path) of records -> the same for all their children; block is then the child's place."""
    met = frontier.join(_addressed(records), "digest")
    child = lambda x, i: F.struct((F.col("block") * BLOCK + i).alias("block"), x.alias("digest"), F.concat("path", segment(F.col("levels"), F.col("height"), i)).alias("path"))
    return met.select("tree", F.inline(F.transform(F.element_at("levels", 1), child)))


def _starts(rows: DataFrame) -> DataFrame:
    return rows.select("tree", F.lit(0).cast("long").alias("block"), "digest", "path")


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """The manifest's leaves with leaf (as found by descent), subroot, root and path: l and r of every level, from the leaf to the root.

    `wanted` (ids) asks for some leaves only: records that hold none of them are not descended into.
    """
    empty = F.array().cast(_PATH)
    requests = manifest.leaves()
    if wanted is not None:
        requests = staged(requests.join(wanted.select("id").distinct(), "id", "left_semi"), "requests")

    def asked(frontier: DataFrame, stage: int) -> DataFrame:
        if wanted is None:
            return frontier
        prefix = requests.select("tree", F.floor(F.col("pos") / BLOCK ** (stage + 1)).cast("long").alias("block")).distinct()
        return frontier.join(prefix, ["tree", "block"], "left_semi")

    if manifest.root is None:
        return requests.select("*", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"), empty.alias("path"))
    spark = manifest.spark
    frontier = spark.createDataFrame([("", manifest.root)], "tree string, digest string").withColumn("path", empty)
    frontier = _starts(frontier)
    for k in range(manifest.top_stages - 1, -1, -1):
        frontier = _step(frontier, manifest.records("top", k))
    named = spark.read.parquet(f"{manifest.path}/subroots").select("name", F.col("pos").alias("block"), "stage")
    trees = staged(frontier.select("block", "digest", "path").join(named, "block").select(F.col("name").alias("tree"), "digest", "path", "stage"), "tree-roots")
    frontier = None
    for k in range(manifest.tree_stages - 1, -1, -1):
        own = _starts(trees.where(F.col("stage") == k))
        frontier = asked(own if frontier is None else own.union(frontier), k)
        if k:
            frontier = staged(_step(frontier, manifest.records("trees", k)), "frontier")
    # of the requests under one record only their places within it go down
    grouped = requests.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
    more = [c for c in requests.columns if c not in ("tree", "pos", "n", "leaf")]
    grouped = grouped.groupBy("tree", "block").agg(F.collect_list(F.struct("pos", *more)).alias("requests"))
    subroots = trees.select("tree", F.col("digest").alias("subroot"))
    met = frontier.join(grouped, ["tree", "block"]).join(subroots, "tree").join(_addressed(manifest.records("trees", 0)), "digest")

    def answer(r: Column) -> Column:
        digits = (r["pos"] % BLOCK).cast("int")
        path = F.reverse(F.concat("path", segment(F.col("levels"), F.col("height"), digits)))
        return F.struct(r["pos"].alias("pos"), *(r[c].alias(c) for c in more), F.get(F.element_at("levels", 1), digits).alias("leaf"), path.alias("path"))

    return met.select("tree", "subroot", F.lit(manifest.root).alias("root"), F.inline(F.transform("requests", answer)))


def proof_digest(path: Column) -> Column:
    """The digest of the siblings on a path."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda a, x: F.sha2(F.concat(x["l"], a, x["r"]), 256))


def verified_documents(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "source", text_col: str = "text", fields: Sequence[str] = FIELDS) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, after a trial tampering.

    Where 2 divides the crc32 of the id, newlines are taken from the text before its leaf is recomputed; folded_root is what that
    leaf and the stored siblings give, verified tells whether it is the root.  A null id is not tampered with,
    a null text stays; null sources are a tree of their own, the first; rows that repeat are leaves each; an empty table
    gives no rows; columns that are not among `fields` are not read.
    """
    cols = [F.col(c) for c in fields]
    struck = [F.replace(c, F.lit("\n")) if f == text_col else c for f, c in zip(fields, cols)]
    tampered = (F.crc32(F.col(id_col).cast("string")) % 2 == 0) & F.contains(text_col, F.lit("\n"))
    leaves = docs.select(tree_name(tree_col).alias("tree"), F.col(id_col).alias("id"), leaf_digest(*cols).alias("leaf"), F.when(tampered, leaf_digest(*struck)).alias("tampered"))
    told = proofs(build_manifest(leaves))
    out = told.select("id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
