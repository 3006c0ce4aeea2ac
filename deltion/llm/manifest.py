"""Merkle manifest of a dataset: leaves per row, a tree per source, a tree over the sources, proofs and their check.

A level is one window step: columns at fixed offsets of lag and lead, masked by the slot of a node in its run and by the
length of the run, are its siblings, and first-child rows hash them to the parent. Windows are keyed by source and a few
runs, so no task holds a source. Proofs are put together from the root down: a parent hands its own to its children.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltion.llm.shared import numbered, settle

#: A-Z in code-point order and what they become.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"
RUNS_PER_WINDOW = 8


def digest(*parts: Column) -> Column:
    """H: lower-case hex SHA-256 of the parts, put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as a leaf takes it: `-` if null, else its number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return digest(*map(field, columns))


def with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """Add `left` and `right`: the digests `h` of the other nodes of the run before and after it, put together.

    `nodes` has tree, at (position from 0) and of (nodes of the tree at this level).
    """
    slot, runs = F.col("at") % fan, F.floor(F.col("at") / (fan * RUNS_PER_WINDOW))
    near = Window.partitionBy("tree", runs).orderBy("at")
    length = F.least(F.lit(fan), F.col("of") - F.col("at") + slot)
    left = [F.when(slot >= k, F.lag("h", k).over(near)).otherwise("") for k in range(fan - 1, 0, -1)]
    right = [F.when(slot + k < length, F.lead("h", k).over(near)).otherwise("") for k in range(1, fan)]
    return nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def parents(nodes: DataFrame, fan: int) -> DataFrame:
    """The next level: what first-child rows hash. Trees of one node have none."""
    first = with_siblings(nodes.where("of > 1"), fan).where(F.col("at") % fan == 0)
    return first.select("tree", F.floor(F.col("at") / fan).alias("at"), F.ceil(F.col("of") / fan).alias("of"), digest(F.col("h"), F.col("right")).alias("h"))


def levels(nodes: DataFrame, fan: int, label: str) -> list[DataFrame]:
    """All levels of all trees from the leaves up, each a written table of (tree, at, of, h)."""
    found, most = [nodes], nodes.agg(F.max("of").alias("n")).first().n or 0
    while most > 1:
        found.append(settle(parents(found[-1], fan), label))
        most = -(-most // fan)
    return found


def tops(found: list[DataFrame]) -> DataFrame:
    """(tree, level, h): the one node that remains of each tree."""
    ends = [nodes.where("of = 1").select("tree", F.lit(k).alias("level"), "h") for k, nodes in enumerate(found)]
    out = ends[0]
    for end in ends[1:]:
        out = out.unionByName(end)
    return out


def paths(found: list[DataFrame], above: DataFrame, fan: int, label: str) -> DataFrame:
    """The leaves with `path`: left and right siblings, level by level, then the path that `above` (tree, level, path) gives the top."""
    upper = None
    for k in range(len(found) - 1, -1, -1):
        ends = above.where(F.col("level") == k).select(F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_at"), "path")
        upper = ends if upper is None else upper.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), "path").unionByName(ends)
        nodes = with_siblings(found[k], fan).withColumn("_up", F.floor(F.col("at") / fan))
        joined = nodes.join(upper, (F.col("tree") == F.col("_tree")) & (F.col("_up") == F.col("_at"))).drop("_tree", "_at", "_up")
        own = F.array(F.struct("left", "right"))
        upper = joined.withColumn("path", F.when(F.col("of") > 1, F.concat(own, "path")).otherwise(F.col("path"))).drop("left", "right")
        if k:
            upper = settle(upper, label)
    return upper


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, step: digest(step["left"], h, step["right"]))


def manifest(docs: DataFrame, columns: list[str], id_column: str = "doc_id", source_column: str = "source", tampered: Callable[[Column], Column] | None = None, text_column: str = "text", tamper_where: Column | None = None, fan: int = 16) -> DataFrame:
    """One row per row of `docs`: doc_id, source, leaf, position, source_rows, subroot, root, path, proof_sha256, folded_root, verified.

    The leaf hashes `columns` in that order. In a source the leaves ascend by id (nulls first), rows with equal ids by leaf;
    rows that are equal altogether have equal leaves, each with its own place. Every `fan` nodes that follow each
    other become one (a last run may have one node) while a source has several; a lone leaf is its subroot. A null source is
    a source and comes first; the subroots give the root in the same way. `folded_root` starts from the leaf in which
    `tampered` has changed the text of the rows of `tamper_where` (null: not), and takes the true siblings; `verified` says whether
    it is the root. Null texts stay null; an empty table gives no rows. Other columns are not read.
    """
    changed = F.coalesce(tamper_where, F.lit(False)) if tamper_where is not None else F.lit(False)
    fields = docs.select(*(F.col(c).alias(f"f{k}") for k, c in enumerate(columns)), F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), changed.alias("changed"))
    texts = [F.col(f"f{k}") for k in range(len(columns))]
    other = [tampered(c) if tampered and name == text_column else c for name, c in zip(columns, texts, strict=True)]
    leaves = fields.select("doc_id", "source", leaf(texts).alias("h"), F.when(F.col("changed"), leaf(other)).alias("tampered"))
    leaves = numbered(leaves, ["source"], ["doc_id", "h"], "at").withColumnRenamed("at_of", "of")
    sources = settle(numbered(leaves.select("source").distinct(), [], ["source"], "tree"), "manifest-sources").select(F.col("source").alias("_source"), "tree")
    leaves = settle(leaves.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "manifest-leaves")

    found = levels(leaves.select("tree", "at", "of", "h"), fan, "manifest-level")
    subroots = settle(tops(found), "manifest-subroots")
    trees = subroots.agg(F.count(F.lit(1)).alias("n")).first().n
    over = levels(settle(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("at"), F.lit(trees).alias("of"), "h"), "manifest-sources"), fan, "manifest-level")
    root = (tops(over).select("h").first() or [None])[0]
    none = docs.sparkSession.createDataFrame([(0, len(over) - 1, [])], f"tree int, level int, path {PATH}")
    up = paths(over, none, fan, "manifest-path").select(F.col("at").alias("tree"), "path").join(subroots, "tree")
    up = settle(up.select("tree", "level", "path", F.col("h").alias("subroot")), "manifest-up")

    full = [leaves, *found[1:]]
    rows = paths(full, up.select("tree", "level", "path"), fan, "manifest-path").join(up.select("tree", "subroot"), "tree")
    proof = F.aggregate("path", F.lit(""), lambda a, step: F.concat(a, step["left"], step["right"]))
    rows = rows.select("doc_id", "source", F.col("h").alias("leaf"), F.col("at").alias("position"), F.col("of").alias("source_rows"), "subroot", F.lit(root).cast("string").alias("root"), "path", digest(proof).alias("proof_sha256"), fold(F.coalesce("tampered", "h"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
