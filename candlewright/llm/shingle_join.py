"""Exact Jaccard self-join of word shingle sets by T-occurrence search (DivideSkip).

A document of n shingles needs at least T = ceil(t n) of them in common with any partner. Its inverted
lists are ordered by length (document frequency, ties by shingle), and the L longest, by the DivideSkip
rule L = T / (MU log2 M + 1) for a longest list of M, are set aside. The others, the short lists, are
merged: a partner has to occur in T - L of them at least. Only partners that do are then looked up in
the long lists, by binary search, and those that reach the required overlap stay.

The order is the same for all documents, so of two partners the one whose short lists end first asks
the other: what both have in common among its short lists is also among the other's short ones. So only
short lists are dealt out, and short lists plus the asker's long ones give the whole overlap. Lists of
one document are left out; they count in n. No step loses a pair that reaches the threshold.

On Spark: a list is a group of rows by shingle, of at most `block` rows a part; the parts' partners of
a document, as arrays of ids and counts, go to the blocks of documents that hold the partners' sets.
There the arrays are merged by sorted runs, and the block's own index (shingle, document) serves as the
sorted long lists.

Hot groups. Documents with equal sets are one node from the start. A group of near copies is joined by
rounds first: every list still holding several components takes one leader, the leader's whole set is
probed for the members of other components, and components are worked out anew, as long as a round
leaves clearly fewer rows in such lists. Only then are the lists merged as above, between different
components; a list with one large component compares the rest with it, not its members with each other.
Each task keeps a union-find over the components it meets and returns an edge only where it joins two,
so a group of n near copies gives about n links and not n squared.

Numbers: document frequencies are counted over all documents by packed sets (exchange.py). Nodes are
64-bit fingerprints of the set.

Cases: null and empty texts, and texts without a word, have an empty set and link with nothing. With
fewer than `k` words the whole sequence is the one shingle. Texts are read whole. Repeated rows have
equal sets; one text per input task of those with equal id and text travels. Null ids are treated as
one lowest id and reported as null. An empty table gives an empty result. Input columns other than the
two named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm import exchange as X
from candlewright.llm import words as W
from candlewright.llm.common import text_size, written
from candlewright.llm.components import components

NO_ID = -(2**63)
#: Weight of merging against probing in the DivideSkip rule.
MU = 0.001
#: Rows of list parts that one task merges together: a few parts of `block` rows, whose pairs fit in memory.
CELL_ROWS = 4096


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each, and each text's first (n + 1 numbers)."""
    low = W.LOWER_AZ[buf]
    starts, ends, first = W.word_spans(low, offsets)
    h = W.span_hashes(low, starts, ends)
    found, at = W.windows(h, first, k)
    doc = W.documents_of(first)[at]
    count = np.diff(first)
    for n in range(1, k):  # shorter texts are one shingle
        short = np.flatnonzero(count == n)
        if len(short):
            w, at = W.windows(h[np.repeat(first[short], n) + np.tile(np.arange(n), len(short))], np.arange(len(short) + 1) * n, n)
            found, doc = np.concatenate([found, w]), np.concatenate([doc, short[at // n]])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return found[new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def fingerprints(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    out = []
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(values ^ salt), dtype=np.uint64)])
        out.append(W.mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _sets_of(column, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    buf, offsets = W.text_buffer(column)
    for lo, hi in W.slices(offsets):
        yield (lo, *shingle_sets(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k))


def divide(n: int, longest: int, p: int, q: int) -> int:
    """How many of the longest lists are set aside: fewer than the occurrences needed."""
    need = -(-p * n // q)
    return min(need - 1, int(need / (MU * math.log2(max(longest, 2)) + 1)))


class Union:
    """Components met by one task, joined as links are found."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            self.up[y] = x
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.top(x)] = self.top(y)


class Lists:
    """The inverted lists of a block of documents: pairs (shingle, document), sorted."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        size = [len(x) for x in sets]
        self.of = max(len(sets), 1)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.tokens, at = np.unique(values, return_inverse=True)
        self.pairs = np.sort(at * self.of + np.repeat(np.arange(len(sets)), size))

    def occurrences(self, tokens: np.ndarray, documents: np.ndarray) -> np.ndarray:
        """In how many of the tokens' lists each document stands, by binary search."""
        tokens = tokens[X.found_in(self.tokens, tokens)]
        out = np.zeros(len(documents), np.int64)
        if len(tokens):
            at = np.searchsorted(self.tokens, tokens) * self.of
            for lo in range(0, len(documents), 64):
                wanted = at[:, None] + documents[None, lo : lo + 64]
                out[lo : lo + 64] = X.found_in(self.pairs, wanted.ravel()).reshape(wanted.shape).sum(0)
        return out


def _joined(p: int, q: int, ask: pa.Table, own: pa.Table) -> pa.Table:
    """Links of the askers with documents of one block, one for each two components that they join.

    ask: (a, la, n, l, packed, others, labels, counts), repeated others to be added up; where `counts` is
    null, nothing was counted before and `packed` is the whole set.
    """
    links: tuple[list, list] = ([], [])
    if len(ask) and len(own):
        fps = own["other"].to_numpy()
        order = np.argsort(fps)
        fps, size = fps[order], own["size"].to_numpy()[order]
        short, long = own["short"], own["long"]
        lists = Lists([np.concatenate([W.unpack_sorted(short[i].as_py()), W.unpack_sorted(long[i].as_py())]) for i in order.tolist()])
        found = Union()
        flat, ends = {}, ask["others"].combine_chunks().offsets.to_numpy()
        for c in ("others", "labels", "counts"):
            column = ask[c].combine_chunks()
            flat[c] = None if column.null_count else column.values.to_numpy()
        plain = [ask[c].to_pylist() for c in ("a", "la", "n", "l", "packed")]
        for i, (me, label, n, aside, packed) in enumerate(zip(*plain, strict=True)):
            mine = slice(ends[i], ends[i + 1])
            others, at, of = np.unique(flat["others"][mine], return_index=True, return_inverse=True)
            labels = flat["labels"][mine][at]
            here = np.searchsorted(fps, others)
            need = -(-p * (n + size[here]) // (p + q))
            count = np.zeros(len(others), np.int64)
            if flat["counts"] is not None:
                np.add.at(count, of, flat["counts"][mine])
                keep = np.flatnonzero(count >= need - aside)
                keep = keep[np.argsort(-count[keep], kind="stable")]
                others, labels, here, need, count = others[keep], labels[keep], here[keep], need[keep], count[keep]
            tokens = np.concatenate([W.unpack_sorted(x) for x in packed])
            for lo in range(0, len(others), 64):
                left = np.array([j for j in range(lo, min(lo + 64, len(others))) if found.top(int(labels[j])) != found.top(label)], np.int64)
                if len(left):
                    total = count[left] + lists.occurrences(tokens, here[left])
                    for j in left[total >= need[left]].tolist():
                        if found.top(int(labels[j])) != found.top(label):
                            found.join(int(labels[j]), label)
                            links[0].append(me)
                            links[1].append(int(others[j]))
    return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})


def _partners(p: int, q: int, group: pa.Table) -> pa.Table:
    """For every asker in the parts of lists of one cell: its partners, and in how many of these lists each stands."""
    columns = ("slot", "two", "side", "fp", "n", "place", "cdf", "ctok", "label")
    group = group.sort_by([("slot", "ascending")])
    slot, two, side, fp, n, place, cdf, ctok, label = (group[c].to_numpy(zero_copy_only=False) for c in columns)
    names, at = np.unique(fp, return_inverse=True)
    width, of_name = len(names), np.zeros(len(names), np.int64)
    of_name[at] = label
    rank = np.empty(len(fp), np.int64)
    rank[np.lexsort((fp, ctok, cdf))] = np.arange(len(fp))  # who asks: the one whose short lists end first
    cuts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1], True])
    pairs, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def added() -> None:
        code, of = np.unique(np.concatenate(pairs), return_inverse=True)
        pairs[:], counts[:] = [code], [np.bincount(of, np.concatenate(counts), len(code)).astype(np.int64)]

    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        rows = np.arange(lo, hi)
        halves = [(rows, rows)]
        if two[lo]:
            x, y = rows[side[lo:hi] == 0], rows[side[lo:hi] == 1]
            halves = [(x, y), (y, x)]
        for a, b in halves:
            na, nb = n[a][:, None], n[b][None, :]
            ok = (label[a][:, None] != label[b][None, :]) & (rank[a][:, None] < rank[b][None, :])
            ok &= np.minimum(na, nb) * q >= np.maximum(na, nb) * p
            # Shingles common to both stand before this one in both orders, or behind it in both.
            ia, ib = place[a][:, None], place[b][None, :]
            ok &= (np.minimum(ia, ib) + np.minimum(na - ia, nb - ib)) * (p + q) >= p * (na + nb)
            x, y = np.nonzero(ok)
            pairs.append(at[a[x]] * width + at[b[y]])
            counts.append(np.ones(len(x), np.int64))
        if sum(map(len, pairs)) > 1 << 21:  # a pair meets in many lists
            added()
    added()
    code, count = pairs[0], counts[0]
    asker, other = code // max(width, 1), code % max(width, 1)
    first = np.flatnonzero(np.r_[True, asker[1:] != asker[:-1]]) if len(code) else np.zeros(0, np.int64)
    ends = pa.array(np.append(first, len(code)), pa.int32())
    nested = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (names[other], of_name[other], count)]
    return pa.table({"a": pa.array(names[asker[first]], pa.int64()), "la": pa.array(of_name[asker[first]], pa.int64()), "others": nested[0], "labels": nested[1], "counts": nested[2]})


def _links(found: DataFrame, p: int, q: int, block: int) -> DataFrame:
    """Links (a, b) between nodes that reach the threshold; they hold every component together and are about as many as the nodes.

    found: (fp, n, l, cdf, ctok, short, long, tokens), see `lists` in linked_sets.
    """
    blocks = X.group_count(int(found.agg(F.coalesce(F.sum(F.octet_length("short") + F.octet_length("long")), F.lit(0))).first()[0]))
    block_of = lambda x: F.pmod(F.xxhash64(x), F.lit(blocks)).cast("int")
    own = found.select(F.col("fp").alias("other"), F.col("n").alias("size"), "short", "long", block_of("fp").alias("own"))
    entries = found.select("fp", "n", "cdf", "ctok", F.explode(F.arrays_zip("tokens", "places")).alias("e"))
    entries = entries.select("fp", "n", "cdf", "ctok", F.col("e.tokens").alias("token"), F.col("e.places").alias("place"))
    size = F.count(F.lit(1)).alias("len")
    # Written, so that the joins below have plain inputs: a very long list is a skewed side that can be split.
    real = written(entries.groupBy("token").agg(size).where("len > 1"))
    open_ = written(entries.join(real, "token").withColumn("label", F.col("fp")))

    def checked(asks: DataFrame, packed: F.Column) -> DataFrame:
        whole = asks.join(found.select(F.col("fp").alias("a"), F.col("n").alias("n"), F.col("l").alias("l"), packed.alias("packed")), "a")
        probe = lambda key, ask, own: _joined(p, q, ask, own)
        # A different plan for each side, so that columns of one table are told apart.
        return written(whole.groupBy("blk").cogroup(own.select(*(F.col(c).alias(c) for c in own.columns)).groupBy("own")).applyInArrow(probe, "a long, b long"))

    def mixed(df: DataFrame) -> DataFrame:
        df = written(df)
        several = df.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
        return written(df.join(written(several), "token"))

    near = F.least("n", "leader.n") * q >= F.greatest("n", "leader.n") * p
    links, rows, turn = None, open_.count(), 0
    while rows:
        leaders = written(open_.groupBy("token").agg(F.min_by(F.struct("fp", "n", "label"), F.struct(F.xxhash64("fp", F.lit(turn)), "fp")).alias("leader")))
        lead = open_.join(leaders, "token").where((F.col("label") != F.col("leader.label")) & near)
        lead = lead.select(F.col("leader.fp").alias("a"), F.col("leader.label").alias("la"), "fp", "label").distinct()
        asks = lead.groupBy("a", "la", block_of("fp").alias("blk")).agg(F.collect_list(F.struct("fp", "label")).alias("s"))
        asks = asks.select("a", "la", "blk", F.col("s.fp").alias("others"), F.col("s.label").alias("labels"), F.lit(None).cast("array<long>").alias("counts"))
        new = checked(asks, F.array("short", "long"))
        links = new if links is None else links.unionByName(new)
        label = components(links).select(F.col("id").alias("fp"), "component")
        open_ = mixed(open_.join(label, "fp", "left").withColumn("label", F.coalesce("component", "label")).drop("component"))
        before, rows, turn = rows, open_.count(), turn + 1
        if 4 * rows > 3 * before:
            break
    if not rows:
        return links if links is not None else found.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    # Lists within one part are merged as they are. Longer ones: the rest against the largest component, and the rest with itself.
    sizes = written(open_.groupBy("token", "label").agg(size))
    base = sizes.groupBy("token").agg(F.max_by("label", F.struct("len", "label")).alias("base"), F.max("len").alias("most"), F.sum("len").alias("len"))
    parts = lambda c: F.greatest(F.ceil(F.col(c) / block), F.lit(1)).cast("int")
    base = base.withColumn("whole", F.col("len") <= block).withColumn("pb", parts("most")).withColumn("pr", F.ceil((F.col("len") - F.col("most")) / block).cast("int"))
    df = open_.drop("len").join(written(base), "token").withColumn("is_base", F.col("label") == F.col("base"))
    df = df.withColumn("part", F.pmod(F.xxhash64("fp"), F.when(F.col("is_base"), F.col("pb")).otherwise(F.col("pr"))).cast("int"))
    place = lambda two, side, i, j: F.struct(F.lit(two).alias("two"), F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    steps = lambda n: F.sequence(F.lit(0), n - 1)
    part = F.col("part")
    with_rest = F.transform(steps(F.col("pr")), lambda j: F.struct((j != part).alias("two"), F.when(part < j, 0).otherwise(1).alias("side"), F.least(part, j).alias("i"), (F.greatest(part, j) + 1).alias("j")))
    # Slots of the base with the rest have j = -1 - (part of the rest), so no two kinds meet.
    as_rest = F.concat(F.transform(steps(F.col("pb")), lambda i: place(True, 1, i, -1 - part)), with_rest)
    as_base = F.transform(steps(F.col("pr")), lambda j: place(True, 0, part, -1 - j))
    slots = F.when(F.col("whole"), F.array(place(False, 0, F.lit(0), F.lit(0)))).when(F.col("is_base"), as_base).otherwise(as_rest)
    df = df.withColumn("s", F.explode(slots)).select(F.xxhash64("token", "s.i", "s.j").alias("slot"), "s.two", "s.side", "fp", "n", "place", "cdf", "ctok", "label")
    df = written(df)
    cells = max(1, -(-df.count() // CELL_ROWS))
    merge = lambda key, group: _partners(p, q, group)
    across = df.withColumn("cell", F.pmod("slot", F.lit(cells)).cast("int")).groupBy("cell").applyInArrow(merge, "a long, la long, others array<long>, labels array<long>, counts array<long>")
    split = F.transform(F.arrays_zip("others", "labels", "counts"), lambda x: F.struct(block_of(x["others"]).alias("blk"), x["others"].alias("o"), x["labels"].alias("l"), x["counts"].alias("c")))
    across = across.withColumn("s", split).withColumn("blk", F.explode(F.array_distinct(F.transform("s", lambda x: x["blk"]))))
    across = across.select("a", "la", "blk", F.filter("s", lambda x: x["blk"] == F.col("blk")).alias("s"))
    asks = across.groupBy("a", "la", "blk").agg(F.flatten(F.collect_list("s")).alias("s"))
    asks = asks.select("a", "la", "blk", F.col("s.o").alias("others"), F.col("s.l").alias("labels"), F.col("s.c").alias("counts"))
    return links.unionByName(checked(asks, F.array("long")))


def linked_sets(
    docs: DataFrame, k: int = 4, threshold: tuple[int, int] = (85, 100), block: int = 1000, text: str = "text", id_col: str = "doc_id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets (id, th, n, fp, fp2) per row, nodes (fp, fp2, n, id, th) of different sets, and links (a, b) between nodes."""
    p, q = threshold
    _, size = text_size(docs, text)
    groups, buckets, bits = X.group_count(size), X.bucket_count(size), X.hash_bits(size)
    edges = X.bounds(buckets, bits)
    shift = np.uint64(64 - bits)

    @F.arrow_udf("struct<n:bigint,fp:bigint,fp2:bigint>")
    def outline(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [(np.diff(first), *fingerprints(values, first)) for _, values, first in _sets_of(column, k)]
            cols = [pa.array(np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for i in range(3)]
            yield pa.StructArray.from_arrays(cols, ["n", "fp", "fp2"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).alias("text"))
    def once(keyed: DataFrame) -> DataFrame:
        """Without the rows of a task that repeat another's id and text: one of them is enough to look up a set."""

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set = set()
            for batch in batches:
                keys = list(zip(batch.column("id").to_pylist(), batch.column("th").to_pylist(), strict=True))
                new = []
                for key in keys:
                    new.append(key not in seen)
                    seen.add(key)
                yield batch if all(new) else batch.filter(pa.array(new, pa.bool_()))

        return keyed.mapInArrow(first, keyed.schema)

    # A node's text is looked up by id and text hash, which also deal it: an id of very many rows fills no group.
    th = F.xxhash64("text").alias("th")
    sets = written(rows.select("id", th, outline("text").alias("s")).select("id", "th", "s.*"))
    nodes = sets.where("n > 0").groupBy("fp", "fp2", "n").agg(F.min(F.struct("id", "th")).alias("x")).select("fp", "fp2", "n", "x.*")
    wanted = X.grouped(nodes.select("id", "th", "fp"), groups, "id", "th").drop("th").withColumnRenamed("__grp", "grp")
    dealt = X.grouped(once(rows.select("id", "text", th)), groups, "id", "th").drop("th")

    def chosen(group: pa.Table, ids: list, fps: list) -> Iterator[tuple[int, np.ndarray]]:
        """Fingerprint and set of every node whose text is in this group."""
        left = set(zip(ids, fps, strict=True))
        own = group["id"].to_pylist()
        for lo, values, first in _sets_of(group["text"], k):
            fp, _ = fingerprints(values, first)
            for i, f in enumerate(fp.tolist()):
                if (own[lo + i], f) in left:
                    left.discard((own[lo + i], f))
                    yield f, values[first[i] : first[i + 1]]

    def count(key: tuple, group: pa.Table, want: pa.Table) -> pa.Table:
        found = [s for _, s in chosen(group, want["id"].to_pylist(), want["fp"].to_pylist())] if len(group) else []
        values, n = np.unique(np.concatenate(found) >> shift if found else np.zeros(0, np.uint64), return_counts=True)
        return X.sent_table(X.to_buckets(values, n, edges, group["__grp"][0].as_py() if len(group) else 0))

    def frequent(key: tuple, sent: pa.Table) -> pa.Table:
        values, n, of, number = X.merged(sent)
        df = np.bincount(number, n)[number].astype(np.int64)
        return X.to_groups(sent, values, df, of, df > 1)

    node_schema = "fp long, n long, l long, cdf long, ctok long, short binary, long binary, tokens array<long>, places array<int>"

    def lists(key: tuple, group: pa.Table, back: pa.Table) -> pa.Table:
        """For every node with a list to be merged: its sets of short and long lists, where the short ones end, and the lists shared with others."""
        out: dict[str, list] = {c: [] for c in ("fp", "n", "l", "cdf", "ctok", "short", "long", "tokens", "places")}
        if len(group) and len(back):
            asked = back.filter(pc.is_valid(back["id"]))
            hits, df = X.received(back.filter(pc.is_null(back["id"])), edges)
            for fp, values in chosen(group, asked["id"].to_pylist(), asked["fp"].to_pylist()):
                n = len(values)
                cut = values >> shift
                known = X.found_in(hits, cut)
                rank = np.ones(n, np.int64)
                rank[known] = df[np.searchsorted(hits, cut[known])]
                order = np.lexsort((values, rank))
                aside = divide(n, int(rank[order[-1]]), p, q)
                short, long = order[: n - aside], order[n - aside :]
                places = np.flatnonzero(rank[short] > 1)
                shared = short[places]
                if len(shared):
                    last = short[-1]
                    # Compared as signed numbers everywhere, so the order of shingles is that of the flipped sign.
                    mark = int((values[last] ^ np.uint64(1 << 63)).view(np.int64))
                    for c, v in zip(out, (fp, n, aside, int(rank[last]), mark, W.pack_sorted(np.sort(values[short])), W.pack_sorted(np.sort(values[long])), values[shared].view(np.int64), places.astype(np.int32)), strict=True):
                        out[c].append(v)
        kinds = (*[pa.int64()] * 5, pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    sent = dealt.groupBy("__grp").cogroup(wanted.groupBy("grp")).applyInArrow(count, X.SENT)
    back = sent.groupBy("bucket").applyInArrow(frequent, X.SENT)
    both = back.unionByName(wanted, allowMissingColumns=True)
    found = written(dealt.groupBy("__grp").cogroup(both.groupBy("grp")).applyInArrow(lists, node_schema))

    return sets, nodes, _links(found, p, q, block)


def join_documents(
    docs: DataFrame, k: int = 4, threshold: tuple[int, int] = (85, 100), block: int = 1000, text: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """doc_id, n_shingles and component_id per row; two documents link when their Jaccard similarity reaches the threshold (a fraction)."""
    sets, nodes, links = linked_sets(docs, k, threshold, block, text, id_col)
    linked = components(links).withColumnRenamed("id", "fp").withColumnRenamed("component", "root")
    named = nodes.select("fp", "id").join(linked, "fp", "left")
    # Written, so that the join below has plain inputs: a component of very many nodes is a skewed side that can be split.
    lowest = written(named.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("low")))
    # As is this one: very many rows may have equal texts.
    known = written(named.join(lowest, "root", "left").select("fp", F.coalesce("low", "id").alias("component_id")))
    out = sets.join(known, "fp", "left")
    real = lambda c: F.when(F.col(c) == NO_ID, None).otherwise(F.col(c))
    return out.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, real("component_id")).otherwise(real("id")).alias("component_id"))
