"""Proportional stratified interleaving: every shard gets the mixture of sources of the whole table.

Rows are ordered within their source by a seeded hash, a row's fractional rank is
(rank - 1/2) / rows of the source, and the table in order of fractional rank is cut into shards
whose sizes differ by one row at most (the law is `rows`).

No window holds a source or the table. Ranks are counted in two steps: the range of the hash is cut
into equal parts, a small table of counts per part gives each part its offset, and row_number runs
inside a part of about rows_per_part rows. A hot source only has more parts with rows in them. The
second ranking, by fractional rank, deals the rows by ranges of (fraction, seeded hash of source and
rank): sources of equal size have equal fractions, and the hash spreads these. Only ids, sizes,
checksums and sources are shuffled, never texts. The order within a part is streamed, never gathered;
rows equal in id, size and checksum are interchangeable there.

Cases: a null source is a source of its own. A null text has size 1 and the checksum 0 of no bytes.
Repeated rows each get a place of their own. An empty table gives an empty result; with fewer rows
than shards some shards stay empty. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.llm.merkle import placed


def _placed(df: DataFrame, group: list[str], part: str, order: list[str], out: str) -> DataFrame:
    """df with out: the row's place from 1 within its group, where part is an ascending function of the order."""
    counts = df.groupBy(*group, part).agg(F.count(F.lit(1)).alias("__n"))
    # The parts of the largest group are still only rows / rows_per_part many.
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*group).orderBy(part)) - F.col("__n")).drop("__n")
    on = [*group, part]
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*on).orderBy(*order)))
    return ranked.join(before, on).withColumn(out, F.col("__before") + F.col("__rn")).drop("__before", "__rn", part)


def interleave(
    docs: DataFrame, shards: int = 8, seed: int = 42, rows_per_part: int = 4_000, id_col: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, fraction, shard and slot (from 0, gapless in each shard)."""
    total = docs.count()
    parts = max(1, -(-total // rows_per_part))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("source"),
        (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
    )
    rows = rows.withColumn("__h", F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed)))
    # 2**63 / parts is the width of a part of the hash; its shifted value is not negative.
    rows = rows.withColumn("__part", F.floor(F.shiftrightunsigned("__h", 1) / F.lit(2.0**63 / parts)))
    # Ascending in the part, so compare hashes as unsigned numbers.
    rows = rows.withColumn("__u", F.shiftrightunsigned("__h", 1))
    rows = _placed(rows, ["source"], "__part", ["__u", "__h", "doc_id", "size", "text_crc32"], "__rank")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("__rows"))
    rows = rows.join(sizes, "source").withColumn("fraction", (F.col("__rank") - 0.5) / F.col("__rows"))
    rows = rows.withColumn("__all", F.lit("")).withColumn("__tie", F.xxhash64("source", "__rank", F.lit(seed)))
    rows = placed(rows, "__all", ["fraction", "__tie", "source", "__rank"], "__total").withColumn("__place", F.col("place") + 1)
    # Shard s holds the places from floor(s * total / shards) on, up to the next shard's first.
    n = F.lit(max(total, 1)).cast("long")
    shard = F.expr(f"(({shards}L * __place) - 1L) div {max(total, 1)}L").cast("int")
    start = F.floor(shard.cast("long") * n / shards)
    return rows.select(
        "doc_id", F.when(F.col("source") == "", F.lit(None)).otherwise(F.substring("source", 2, 2**31 - 1)).alias("source"), "size", "text_crc32", "fraction",
        shard.alias("shard"), (F.col("__place") - 1 - start).cast("long").alias("slot"),
    )
