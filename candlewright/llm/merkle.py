"""Merkle manifest of a dataset: leaves per document, a tree per source, a root over the sources, and a proof per document.

Each parent has up to `fanout` children. A slot pivot finds it: conditional aggregates spread the
children's digests into one column per slot, joining the columns and hashing gives the parent, and
leaving out a child's own slot gives its siblings.

Work goes up in blocks of fanout ** LEVELS nodes that follow each other. A block is dealt and sorted
once, by the base-`fanout` digits of the nodes' places; the groups of every level are prefixes of that
order, so all levels of a block are windows over the same rows without another exchange, and no group
is larger than a block. The blocks' digests, by that factor fewer, are the nodes of the next round. At
the top the subroots of all sources are the nodes of one more tree. Then siblings come down again: each
round joins its nodes with their block's, one row per block. Texts are read once and never shuffled.

Places. A source may hold most rows, so no window holds a source: leaves are range-partitioned by
(source, doc_id, leaf, row), written to the shared folder with their partition's number, and a place is
the row's number in its (partition, source) after the rows of that source in earlier partitions.

Cases: null values hash as "-"; a null source is a source of its own and first; null ids come first and
are not tampered with. Equal ids are ordered by leaf; equal rows are leaves of their own. Empty and very
long texts are hashed whole. An empty table gives an empty result. Columns other than the five are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.llm.common import written

LEVELS = 6
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 of the values, each after its number of bytes."""
    parts = []
    for c in (doc_id, source, lang, n_chars, text):
        s = c.cast("string")
        parts.append(F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, group: str, order: list[str], total: str = "size") -> DataFrame:
    """rows (a table read from files) with `place`, the row's number from 0 in its group, in order, and `total`, the group's rows."""
    ranged = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(group, *order, "__row")
    ranged = written(ranged.withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition that holds rows of the group.
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(group).orderBy("__part")) - F.col("__n"))
    before = before.withColumn(total, F.sum("__n").over(Window.partitionBy(group))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__part", group).orderBy(*order, "__row"))
    return ranged.withColumn("__own", own).join(before, [group, "__part"]).withColumn("place", F.col("__before") + F.col("__own") - 1).drop("__row", "__part", "__own", "__before")


def _climbed(nodes: DataFrame, fanout: int) -> DataFrame:
    """nodes (grp, place, digest, size) with their block, the digest of its top, and their path to it."""
    span = fanout**LEVELS
    nodes = nodes.withColumn("block", F.floor(F.col("place") / span))
    digits = [f"__d{i}" for i in range(LEVELS)]
    nodes = nodes.repartition("grp", "block").select("*", *(F.pmod(F.floor(F.col("place") / fanout**i), F.lit(fanout)).alias(d) for i, d in enumerate(digits)))
    up, steps = F.col("digest"), []
    for i, own in enumerate(digits):
        family = Window.partitionBy("grp", "block", *reversed(digits[i + 1 :]))
        nodes = nodes.withColumn(f"__at{i}", up)
        slots = [f"__slot{i}_{j}" for j in range(fanout)]
        nodes = nodes.select("*", *(F.max(F.when(F.col(own) == j, F.col(f"__at{i}"))).over(family).alias(s) for j, s in enumerate(slots)))
        real = F.col("size") > fanout**i  # several nodes remain at this level
        side = lambda before: F.concat(*(F.when((F.lit(j) < F.col(own)) if before else (F.lit(j) > F.col(own)), F.coalesce(F.col(s), F.lit(""))).otherwise("") for j, s in enumerate(slots)))  # noqa: B023, E731
        steps.append(F.when(real, F.struct(side(True).alias("left"), side(False).alias("right"))))
        up = F.when(real, F.sha2(F.concat(*(F.coalesce(F.col(s), F.lit("")) for s in slots)), 256)).otherwise(F.col(f"__at{i}"))
    path = F.filter(F.array(*steps), lambda x: x.isNotNull()).cast(PATH)
    return nodes.select("grp", "place", "block", up.alias("top"), path.alias("path"), "size")


def climb(nodes: DataFrame, most: int, fanout: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(grp, place, subroot, root, path) of nodes (grp, place, digest, size); a group holds at most `most` nodes. crown extends the groups' tops."""
    if most <= 1:
        return crown(nodes.select("grp", "place", F.col("digest").alias("subroot")))
    low = _climbed(nodes, fanout)
    span = fanout**LEVELS
    blocks = low.groupBy("grp", "block").agg(F.max("top").alias("digest"), F.ceil(F.max("size") / span).alias("size")).withColumnRenamed("block", "place")
    high = climb(blocks, -(-most // span), fanout, crown).withColumnsRenamed({"place": "block", "path": "above"})
    joined = low.drop("size").join(high, ["grp", "block"])
    return joined.select("grp", "place", "subroot", "root", F.concat("path", "above").alias("path"))


def manifest(leaves: DataFrame, fanout: int = 3) -> DataFrame:
    """leaves (source, doc_id, leaf and others, read from files) with subroot, root and path; a path's steps hold the siblings before and after, from below."""
    grp = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # ascending: null first
    rows = placed(leaves.withColumn("grp", grp), "grp", ["doc_id", "leaf"])
    rows = written(rows)

    def crown(tops: DataFrame) -> DataFrame:
        """The tree over the sources."""
        tops = written(tops)
        named = placed(tops.select(F.lit("").alias("all"), F.col("grp").alias("name"), "subroot"), "all", ["name"])
        nodes = named.select(F.col("all").alias("grp"), "place", F.col("subroot").alias("digest"), "size", "name")
        done = lambda top: top.select("grp", "place", "subroot", F.col("subroot").alias("root"), F.array().cast(PATH).alias("path"))
        paths = climb(nodes, tops.count(), fanout, done).select("place", "root", "path")
        names = nodes.select("place", F.col("name").alias("grp"), F.col("digest").alias("subroot"))
        return names.join(paths, "place").select("grp", F.lit(0).cast("long").alias("place"), "subroot", "root", "path")

    most = int(rows.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0])
    found = climb(rows.select("grp", "place", F.col("leaf").alias("digest"), "size"), most, fanout, crown)
    return rows.join(found, ["grp", "place"]).drop("grp", "place", "size")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with its siblings."""
    return F.aggregate(path, leaf, lambda at, x: F.sha2(F.concat(x["left"], at, x["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(x["left"], x["right"]))), 256)


def leaves_of(docs: DataFrame, tampered: Column, changed: Column) -> DataFrame:
    """(doc_id, source, leaf, seen) of documents; seen is the leaf of the text `changed` where tampered, else the leaf."""
    c = [F.col(x) for x in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = leaf_digest(*c)
    return written(docs.select(c[0], c[1].cast("string").alias("source"), leaf.alias("leaf"), F.when(tampered, leaf_digest(*c[:4], changed)).otherwise(leaf).alias("seen")))
