"""Counting 64-bit hashes over all documents without a row per hash.

Documents are dealt into groups of about GROUP_BYTES of text by a hash of their id and text, hashes into
buckets of about BUCKET_HASHES by range. A group sends one packed, sorted set of its different hashes
to each bucket; the bucket merges the sets and sends back to each group those of its hashes that are
asked for. A hash that very many documents hold arrives once per group at most, so it cannot flood
its bucket. Numbers of groups and buckets follow the size of the texts; both sides stay small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm import words as W

GROUP_BYTES = 3 << 20
BUCKET_HASHES = 1 << 20
#: Usual bytes of a word with its space; only sizes the buckets.
WORD_BYTES = 6
SENT = "bucket int, grp int, hashes binary, extra binary"


def group_count(size: int) -> int:
    return max(1, -(-size // GROUP_BYTES))


def bucket_count(size: int) -> int:
    return max(1, -(-size // (WORD_BYTES * BUCKET_HASHES)))


def group_of(groups: int, *columns: str | F.Column) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(groups)).cast("int")


def hash_bits(size: int) -> int:
    """Bits that keep a chance meeting of two different hashes rare (one in ten thousand) among all words."""
    return min(63, max(32, (size // WORD_BYTES + 1).bit_length() + 14))


def bounds(buckets: int, bits: int) -> np.ndarray:
    """First hash of each bucket, and the end."""
    return np.array([(i << bits) // buckets for i in range(buckets + 1)], np.uint64)


def to_buckets(values: np.ndarray, extra: np.ndarray, edges: np.ndarray, group: int) -> dict[str, list]:
    """Rows for ascending distinct values with one number (extra, unsigned 32 bits) each."""
    cuts = np.searchsorted(values, edges)
    cuts[-1] = len(values)
    out: dict[str, list] = {"bucket": [], "grp": [], "hashes": [], "extra": []}
    for b in np.flatnonzero(np.diff(cuts)):
        lo, hi = cuts[b], cuts[b + 1]
        out["bucket"].append(int(b))
        out["grp"].append(group)
        out["hashes"].append(W.pack_sorted(values[lo:hi] - edges[b]))
        out["extra"].append(pack_small(extra[lo:hi]))
    return out


def pack_small(values: np.ndarray) -> bytes:
    """Unsigned numbers in as many bytes each as the largest needs; all equal: once."""
    if len(values) and (values == values[0]).all():
        return b"\x00" + int(values[0]).to_bytes(4, "little")
    width = 1 if values.max(initial=0) < 256 else 4
    return bytes([width]) + values.astype("<u1" if width == 1 else "<u4").tobytes()


def unpack_small(data: bytes, n: int) -> np.ndarray:
    if data[0] == 0:
        return np.full(n, int.from_bytes(data[1:5], "little"), np.int64)
    return np.frombuffer(data, "<u1" if data[0] == 1 else "<u4", offset=1).astype(np.int64)


def sent_table(rows: dict[str, list]) -> pa.Table:
    return pa.table({
        "bucket": pa.array(rows["bucket"], pa.int32()), "grp": pa.array(rows["grp"], pa.int32()),
        "hashes": pa.array(rows["hashes"], pa.binary()), "extra": pa.array(rows["extra"], pa.binary()),
    })


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values and extras of all sets of one bucket (without the bucket's first hash), the set of each, and a number for each different value."""
    sets = [W.unpack_sorted(x) for x in table["hashes"].to_pylist()]
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    extra = np.concatenate([unpack_small(x, n) for x, n in zip(table["extra"].to_pylist(), size, strict=True)])
    order = np.argsort(values, kind="stable")
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(np.r_[False, values[order][1:] != values[order][:-1]])
    return values, extra, np.repeat(np.arange(len(sets)), size), number


def to_groups(table: pa.Table, values: np.ndarray, extra: np.ndarray, of: np.ndarray, keep: np.ndarray) -> pa.Table:
    """The kept values back to their groups, as rows of the same form."""
    rows: dict[str, list] = {"bucket": [], "grp": [], "hashes": [], "extra": []}
    cuts = np.searchsorted(of, np.arange(len(table) + 1))
    bucket, group = table["bucket"].to_pylist(), table["grp"].to_pylist()
    for i in range(len(table)):
        mask = keep[cuts[i] : cuts[i + 1]]
        if mask.any():
            rows["bucket"].append(bucket[i])
            rows["grp"].append(group[i])
            rows["hashes"].append(W.pack_sorted(values[cuts[i] : cuts[i + 1]][mask]))
            rows["extra"].append(pack_small(extra[cuts[i] : cuts[i + 1]][mask]))
    return sent_table(rows)


def received(table: pa.Table, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (ascending) and extras that came back to one group."""
    if not len(table):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values, extra = [], []
    for b, h, x in sorted(zip(table["bucket"].to_pylist(), table["hashes"].to_pylist(), table["extra"].to_pylist(), strict=True)):
        v = W.unpack_sorted(h)
        values.append(v + edges[b])
        extra.append(unpack_small(x, len(v)))
    return np.concatenate(values), np.concatenate(extra)


def found_in(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(wanted), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)] == wanted


def grouped(docs: DataFrame, groups: int, *columns: str | F.Column) -> DataFrame:
    return docs.withColumn("__grp", group_of(groups, *columns))
