"""Merkle manifest of a dataset: 16-ary hash trees per source below one root, proofs, and a climb.

* *Build.* Leaves are hashed in one pass over the texts. Their places inside a source come from a
  range partitioning by (source, doc_id): counts per (source, piece) give the offsets, so a source of
  any size is ranked by many tasks. Level by level, 16 neighbours are hashed into their parent; every
  level is a sixteenth of the one below. The sources' last nodes are the leaves of a second tree.
* *Store.* Built levels are stored as parent-linked rows, one per inner node: the digests of its
  children, and where it stands itself (stage, level, place and slot of its parent).
* *Climb.* A recursive query starts at every leaf with its tampered hash. Each step joins the parent's
  row, puts the folded hash into its slot among the siblings, hashes, appends the siblings' address
  to the path and goes on to the parent's parent, through the source's tree and the second one.

The nodes near the root are met by all leaves. So leaves climb in *blocks* of ``BLOCK`` neighbours
and every block has its own copy of the few nodes above it: the join's key is (tree, block, node),
no key has more than ``BLOCK`` rows, and the copies are a small part of the leaves. Siblings are
appended by address (node and slot), not by value: five levels of 15 digests would be more than the
text, in every step of the recursion. They are looked up once, in the block's nodes, for the proof.

Defined results: a NULL field hashes as '-'; NULL sources are one source, the first; a NULL ``doc_id``
stands before the others of its source and is never tampered with; rows of equal ids stand in the
order of their hashes, so repeated rows are interchangeable; a source of one document has its leaf as
subroot, a table of one source its subroot as root; an empty table has no rows; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip.llm.store import written

FANOUT = 16
BLOCK = 256  # leaves that climb together: two levels
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
HEX = 64
TAMPER_EVERY = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Trees: those of the sources by name ('' for NULL), and the one over their subroots.
TOP = "top"


def field(c: Column) -> Column:
    """A value as it is hashed: its length in bytes and itself, or '-'."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(text: Column, fields: list[str] = FIELDS) -> Column:
    """Hash of a row whose text is ``text``."""
    return F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in fields]), 256)


def hashed(documents: DataFrame) -> DataFrame:
    """One stored row per document: doc_id, tree (of its source), leaf, and the hash it has when tampered with."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPER_EVERY == 0, F.lit(False))
    leaf = leaf_hash(F.col("text"))
    tampered = F.when(chosen, leaf_hash(F.translate("text", UPPER, LOWER))).otherwise(leaf)
    # 's' keeps the order of the names and leaves '' to NULL, which comes first.
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source")))
    return written(documents.select("doc_id", tree.alias("tree"), leaf.alias("digest"), tampered.alias("tampered")), "leaves")


def placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with their place (from 0) inside ``tree`` by the order of ``by``, and the tree's size ``n``.

    Pieces are range partitions; a key of the joins has the rows of one piece at most.
    """
    at = F.monotonically_increasing_id()
    cut = written(rows.repartitionByRange("tree", *by).sortWithinPartitions("tree", *by).withColumn("_at", at), "sorted")
    cut = cut.withColumn("_piece", F.shiftright("_at", 33))
    pieces = cut.groupBy("tree", "_piece").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = F.expr("sum(_size) OVER (PARTITION BY tree ORDER BY _piece) - _size")
    pieces = pieces.select("tree", "_piece", "_first", before.alias("_before"), F.expr("sum(_size) OVER (PARTITION BY tree)").alias("n"))
    out = cut.join(pieces, ["tree", "_piece"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before"))
    return written(out.drop("_at", "_piece", "_first", "_before"), "placed")


def up(place: Column, levels: int | Column) -> Column:
    """Place of the ancestor so many levels above."""
    return F.floor(place / F.pow(F.lit(float(FANOUT)), levels)).cast("long") if isinstance(levels, Column) else F.floor(place / FANOUT**levels).cast("long")


def depth(n: Column) -> Column:
    """Number of levels above the leaves of a tree of n leaves."""
    return reduce(lambda out, k: F.when(n > FANOUT**k, k + 1).otherwise(out), range(1, 15), F.when(n > 1, 1).otherwise(0))


def families(leaves: DataFrame) -> DataFrame:
    """Inner nodes of all trees of ``leaves`` (tree, place, n, digest): tree, n, level, place, children, digest."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    level, out = leaves.select("tree", "place", "n", "digest"), None
    k = 1
    while most > 1:
        several = level.filter(F.col("n") > FANOUT ** (k - 1))
        parent = several.groupBy("tree", "n", up(F.col("place"), 1).alias("up")).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("_c"))
        children = F.array_join(F.transform("_c", lambda c: c["digest"]), "")
        level = written(parent.select("tree", "n", F.lit(k).alias("level"), F.col("up").alias("place"), children.alias("children"), F.sha2(children, 256).alias("digest")), "level")
        out = level if out is None else out.unionByName(level)
        most, k = -(-most // FANOUT), k + 1
    if out is None:
        out = leaves.limit(0).select("tree", "n", F.lit(0).alias("level"), "place", F.lit("").alias("children"), "digest")
    return out


def tops(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, digest) of the last node of every tree."""
    alone = leaves.filter("n = 1").select("tree", "digest")
    return alone.unionByName(nodes.filter(F.col("level") == depth(F.col("n"))).select("tree", "digest"))


ADDRESS = "struct<stage:int,level:int,place:bigint>"


def address(stage: int, level: Column, place: Column, there: Column) -> Column:
    """A node: stage 0 is a source's tree, 1 the one above; NULL where there is none."""
    return F.when(there, F.struct(F.lit(stage).alias("stage"), level.cast("int").alias("level"), place.alias("place"))).cast(ADDRESS)


def above_source(ordinal: Column, sources: Column) -> dict[str, Column]:
    """Parent of a source's last node, the source being number ``ordinal`` of ``sources``."""
    return {"parent": address(1, F.lit(1), up(ordinal, 1), sources > 1), "slot": F.pmod(ordinal, F.lit(FANOUT)).cast("int")}


def manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (blocks, nodes) for placed ``leaves``.

    Blocks: tree, block, n, ordinal, sources, subroot, root. Nodes, a copy for every block below:
    tree, block, node (address), children, parent (address) and slot.
    """
    own = families(leaves)
    roots = tops(leaves, own).select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest")
    roots = placed(roots, ["name"])
    over = families(roots)
    top = tops(roots, over).select(F.col("tree").alias("_top"), F.col("digest").alias("root"))
    # One row: the whole table's root.
    roots = roots.withColumn("_top", F.lit(TOP)).join(F.broadcast(top), "_top")
    roots = roots.select(F.col("name").alias("tree"), F.col("place").alias("ordinal"), F.col("n").alias("sources"), F.col("digest").alias("subroot"), "root")
    blocks = leaves.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.max("n").alias("n")).join(roots, "tree")
    blocks = written(blocks, "merkle-blocks")

    last = F.col("level") >= depth(F.col("n"))
    link = above_source(F.col("ordinal"), F.col("sources"))
    in_source = F.coalesce(address(0, F.col("level") + 1, up(F.col("place"), 1), ~last), link["parent"])
    slot = F.when(last, link["slot"]).otherwise(F.pmod("place", F.lit(FANOUT)).cast("int"))
    row = ["tree", "block", address(0, F.col("level"), F.col("place"), F.lit(True)).alias("node"), "children", in_source.alias("parent"), slot.alias("slot")]
    # Two levels lie inside a block, all further ones above it.
    low = own.filter("level <= 2").withColumn("block", F.when(F.col("level") == 1, up(F.col("place"), 1)).otherwise(F.col("place")))
    low = low.join(blocks.drop("n"), ["tree", "block"]).select(*row)
    lines = blocks.filter(F.col("n") > BLOCK).withColumn("level", F.explode(F.sequence(F.lit(3), depth(F.col("n")))))
    lines = lines.withColumn("place", up(F.col("block"), F.col("level") - 2))
    high = lines.join(own.drop("n").filter("level > 2"), ["tree", "level", "place"]).select(*row)
    lines = blocks.filter("sources > 1").withColumn("level", F.explode(F.sequence(F.lit(1), depth(F.col("sources")))))
    lines = lines.withColumn("place", up(F.col("ordinal"), F.col("level")))
    over = over.select(F.col("n").alias("sources"), "level", "place", "children")
    last = F.col("level") >= depth(F.col("sources"))
    parent = address(1, F.col("level") + 1, up(F.col("place"), 1), ~last)
    row = ["tree", "block", address(1, F.col("level"), F.col("place"), F.lit(True)).alias("node"), "children", parent.alias("parent"), F.pmod("place", F.lit(FANOUT)).cast("int").alias("slot")]
    upper = lines.join(over, ["sources", "level", "place"]).select(*row)
    return blocks, written(low.unionByName(high).unionByName(upper), "merkle-nodes")


CLIMB = f"""
WITH RECURSIVE climb (tree, block, doc_id, leaf, folded, parent, slot, path) AS (
  SELECT tree, block, doc_id, leaf, tampered, parent, slot, CAST(array() AS array<struct<node:{ADDRESS},slot:int>>) FROM {{leaves}}
  UNION ALL
  SELECT c.tree, c.block, c.doc_id, c.leaf,
    unhex(sha2(concat(substr(n.children, 1, {HEX} * c.slot), lower(hex(c.folded)), substr(n.children, {HEX} * (c.slot + 1) + 1)), 256)),
    n.parent, n.slot, array_append(c.path, named_struct('node', c.parent, 'slot', c.slot))
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.block = n.block AND c.parent = n.node
)
SELECT tree, block, doc_id, leaf, folded, path FROM climb WHERE parent IS NULL
"""
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def climbed(leaves: DataFrame, blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored (tree, block, doc_id, leaf, folded, path) of every leaf at the root; hashes as bytes."""
    spark = leaves.sparkSession
    start = leaves.withColumn("block", F.floor(F.col("place") / BLOCK)).join(blocks.drop("n"), ["tree", "block"])
    alone, link = F.col("n") == 1, above_source(F.col("ordinal"), F.col("sources"))
    parent = F.coalesce(address(0, F.lit(1), up(F.col("place"), 1), ~alone), link["parent"])
    slot = F.when(alone, link["slot"]).otherwise(F.pmod("place", F.lit(FANOUT)).cast("int"))
    start = start.select("tree", "block", "doc_id", F.unhex("digest").alias("leaf"), F.unhex("tampered").alias("tampered"), parent.alias("parent"), slot.alias("slot"))
    # The query's rows are leaves times levels; Spark's limit of a million guards against endless ones.
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return written(spark.sql(CLIMB, leaves=start, nodes=nodes), "climbed")
    finally:
        spark.conf.set(ROW_LIMIT, limit)


def proofs(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, folded_root, and ``siblings``: per level one
    string of the siblings' digests, from the leaf's own level to the root's."""
    rows = placed(hashed(documents), ["doc_id", "digest"])
    blocks, nodes = manifest(rows)
    top = climbed(rows, blocks, nodes)
    # At most 17 nodes of two levels and one of each further level.
    known = nodes.groupBy("tree", "block").agg(F.map_from_entries(F.collect_list(F.struct("node", "children"))).alias("_nodes"))
    known = blocks.join(known, ["tree", "block"], "left").select("tree", "block", "subroot", "root", "_nodes")

    def others(step: Column) -> Column:
        children = F.element_at("_nodes", step["node"])
        return F.concat(F.substring(children, F.lit(1), HEX * step["slot"]), F.substring(children, HEX * (step["slot"] + 1) + 1, F.length(children)))

    hexed = lambda c: F.lower(F.hex(c))
    return top.join(known, ["tree", "block"]).select("doc_id", hexed("leaf").alias("leaf"), "subroot", "root", F.transform("path", others).alias("siblings"), hexed("folded").alias("folded_root"))


def op12(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    proof = F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256")
    return proofs(documents).select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
