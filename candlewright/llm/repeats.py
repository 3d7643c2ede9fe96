"""Exact removal of repeated word windows by fixed-block anchors.

A window is `window` consecutive words; every word covered by a window that also starts anywhere
else, in the same document or another, is removed. The windows are judged on the input.

1. Anchors. Every document is cut into blocks of (window + 1) // 2 words from its first word on, and
   these blocks are the index. Whatever the alignment, a repeated window holds a whole block of each
   of its occurrences, so a window can only repeat if one of the rolling block-long word runs in it
   equals a block somewhere and occurs twice. All rolling runs probe the index.
2. Extension. Only windows over an anchor are compared in full, by the hash of all their words: one
   that occurs twice is an exact repeat, and the union of such windows is the maximal repeat.

No pair of places is ever formed, so a passage shared by a third of all documents costs one packed
entry per group of documents (see exchange.py). Anchor hashes may meet by chance, which the second
step undoes; windows are compared by 62 bits of their hash. The texts are shuffled once; the three
steps that read them reuse that exchange, and no executor needs another's local files.

What is left of a text is the text without the removed words and the white space after each; a text
that loses no word stays as it is, to the byte. The digest is of the kept words joined by one space.

Cases: null and empty texts have no words and stay as they are. Texts are read whole, whatever their length. Repeated rows repeat each other's windows and lose them all. Rows are
dealt by id, text and their number in the input, so no null or repeated id fills a group. An empty table gives an empty result. Further columns pass
through; one called like an output column is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm import exchange as X
from candlewright.llm import words as W
from candlewright.llm.common import text_size

WINDOW_BITS = 62


def _hashed(column):
    """Slice by slice: bytes of a group's texts, first byte of each, and spans and hashes of their words."""
    buf, offsets = W.text_buffer(column)
    for lo, hi in W.slices(offsets):
        own, off = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = W.word_spans(own, off)
        yield own, off, starts, ends, first, W.span_hashes(own, starts, ends)


def _joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _kept_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """Kept words of every document, joined by one space."""
    s, size = starts[keep], (ends - starts)[keep]
    count = np.concatenate([[0], np.cumsum(keep)])[first]
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 32, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[inner + np.repeat(at[:-1], size)] = buf[inner + np.repeat(s, size)]
    raw = out.tobytes()
    return [raw[a : b - 1] if b > a else b"" for a, b in zip(at[count[:-1]], at[count[1:]], strict=True)]


def _cut(buf: np.ndarray, off: np.ndarray, starts: np.ndarray, first: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The texts without the bytes of removed words and of the white space after them."""
    after = np.append(starts[1:], len(buf))
    last = first[1:][np.diff(first) > 0] - 1
    after[last] = off[1:][np.diff(first) > 0]
    gone = np.zeros(len(buf) + 1, np.int64)
    np.add.at(gone, starts[~keep], 1)
    np.add.at(gone, after[~keep], -1)
    left = np.cumsum(gone)[:-1] == 0
    raw, at = buf[left].tobytes(), np.concatenate([[0], np.cumsum(left)])[off]
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text", id_col: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """docs (without the text, or with what is left of it) and n_words, n_removed, kept_sha256."""
    block = (window + 1) // 2
    _, size = text_size(docs, text)
    groups, buckets = X.group_count(size), X.bucket_count(size)
    bits = X.hash_bits(size)
    near, exact = X.bounds(buckets, bits), X.bounds(buckets, WINDOW_BITS)
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "__grp")
    # The row's number spreads rows that repeat both id and text. The steps below reuse one exchange, so it is drawn once.
    dealt = X.grouped(docs, groups, id_col, text, F.monotonically_increasing_id())
    others = [c for c in docs.columns if c != text or keep_text]
    schema = docs.select(others).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def runs(key: tuple, group: pa.Table) -> pa.Table:
        """Different rolling runs of a group: 1 stands for a block of the index, 2 for a run that occurs twice here."""
        found, blocks = [], []
        for _, _, _, _, first, h in _hashed(group[text]):
            w, at = W.windows(h, first, block)
            w >>= np.uint64(64 - bits)
            start = np.repeat(first[:-1], np.diff(first))[at]
            found.append(w)
            blocks.append(w[(at - start) % block == 0])
        values, count = np.unique(_joined(found), return_counts=True)
        index = np.unique(_joined(blocks))
        flags = X.found_in(index, values) + 2 * (count > 1)
        return X.sent_table(X.to_buckets(values, flags.astype(np.int64), near, key[0].as_py()))

    def anchors(key: tuple, sent: pa.Table) -> pa.Table:
        values, flags, of, number = X.merged(sent)
        seen = np.bincount(number) + np.bincount(number, (flags & 2) > 0)
        keep = (seen[number] >= 2) & (np.bincount(number, flags & 1)[number] > 0)
        return X.to_groups(sent, values, flags, of, keep)

    def candidates(key: tuple, group: pa.Table, sent: pa.Table) -> pa.Table:
        """Windows over an anchor: 2 stands for one that occurs twice in this group."""
        hits, _ = X.received(sent, near)
        found = []
        if len(hits):
            for _, _, _, _, first, h in _hashed(group[text]):
                w, at = W.windows(h, first, block)
                on = np.zeros(len(h) + 1, np.int64)
                on[at + 1] = X.found_in(hits, w >> np.uint64(64 - bits))
                on = np.cumsum(on)
                w, at = W.windows(h, first, window)
                found.append(w[on[at + window - block + 1] > on[at]] >> np.uint64(64 - WINDOW_BITS))
        values, count = np.unique(_joined(found), return_counts=True)
        return X.sent_table(X.to_buckets(values, 2 * (count > 1).astype(np.int64), exact, group["__grp"][0].as_py() if len(group) else 0))

    def repeated(key: tuple, sent: pa.Table) -> pa.Table:
        values, flags, of, number = X.merged(sent)
        seen = np.bincount(number) + np.bincount(number, flags > 0)
        return X.to_groups(sent, values, flags, of, seen[number] >= 2)

    def removed(key: tuple, group: pa.Table, sent: pa.Table) -> pa.Table:
        hits, _ = X.received(sent, exact)
        texts, left, total, gone = [], [], [], []
        for buf, off, starts, ends, first, h in _hashed(group[text]):
            w, at = W.windows(h, first, window)
            at = at[X.found_in(hits, w >> np.uint64(64 - WINDOW_BITS))]
            cover = np.bincount(at, minlength=len(h) + 1) - np.bincount(at + window, minlength=len(h) + 1)
            keep = np.cumsum(cover)[: len(h)] == 0
            texts += _kept_words(buf, starts, ends, first, keep)
            left += _cut(buf, off, starts, first, keep) if keep_text else []
            total.append(np.diff(first))
            gone.append(np.diff(np.concatenate([[0], np.cumsum(~keep)])[first]))
        out = group.select(others) if len(group) else group.slice(0, 0).select(others)
        if keep_text:
            was_null = np.asarray(group[text].is_null()) if len(group) else np.zeros(0, bool)
            out = out.set_column(out.column_names.index(text), text, pa.array(left, pa.binary(), mask=was_null).cast(pa.string()))
        out = out.append_column("n_words", pa.array(_joined(total, np.int64), pa.int64())).append_column("n_removed", pa.array(_joined(gone, np.int64), pa.int64()))
        return out.append_column("kept_sha256", pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()))

    sent = dealt.groupBy("__grp").applyInArrow(runs, X.SENT)
    back = sent.groupBy("bucket").applyInArrow(anchors, X.SENT)
    sent = dealt.groupBy("__grp").cogroup(back.groupBy("grp")).applyInArrow(candidates, X.SENT)
    back = sent.groupBy("bucket").applyInArrow(repeated, X.SENT)
    return dealt.groupBy("__grp").cogroup(back.groupBy("grp")).applyInArrow(removed, schema)
