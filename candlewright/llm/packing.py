"""Best-two-fit packing of tokenised documents into sequences of fixed length.

Only a document longer than a sequence is cut, into full pieces and a rest. The pieces are dealt by
a hash into blocks of about rows_per_block pieces, and every block is packed by one task, so nothing
grows with the table but the number of blocks; a block of tens of thousands of random pieces loses
less than one sequence against packing all at once.

Within a block a bin starts with the longest piece left and takes the longest piece that still fits
until none does. If a gap is left, the bin's smallest piece (but not its first) is taken out and
replaced by the two unpacked pieces that fill the widened gap most tightly, if they fill it better
than that piece did. Lengths are whole numbers up to the sequence length, so the block is a count
per length, and a best pair is found from a table of the longest unpacked length below each gap.

Tokens: the words of a text are split by the vocabulary's own rules, each different word of a task is
encoded once by its model, and the ids are laid out by place. Words with signs outside ASCII and
Latin-1 letters, an apostrophe or "<|", go through the tokenizer as a whole.

Cases: a null or empty text is the end token alone, one piece of length 1. Texts are read whole.
Repeated rows and ids are packed row by row; equal lengths are taken in order of id and piece. An
empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm import words as W
from candlewright.llm.common import written

#: Kinds of bytes in the plain path: 0 space, 1 letter, 2 digit, 3 sign; 9 sends the word to the tokenizer.
_KIND = np.full(256, 3, np.uint8)
_KIND[W.SPACES] = 0
_KIND[~W.NOT_TERM] = 1
_KIND[48:58] = 2
_KIND[128:] = 9
_KIND[[39, *range(0, 9), *range(14, 32), 127]] = 9


#: The character that stands for a byte in a byte-level vocabulary: printable Latin-1 is itself, the others follow from 256 on.
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


class WordTokenizer:
    """Token ids of whole texts by a `tokenizers` file whose tokens never span ASCII white space."""

    def __init__(self, path: str, keep: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, keys: np.ndarray, spans: list[str], odd: np.ndarray) -> None:
        """spans: the bytes of each new token as Latin-1."""
        found, tokenize = [], self.model.tokenize
        for span, by_rule in zip(spans, odd.tolist(), strict=True):
            if by_rule:
                found.append(self.whole.encode(span.encode("latin-1").decode("utf-8", "replace"), add_special_tokens=False).ids)
            else:
                found.append([t.id for t in tokenize(span if span.isascii() else span.translate(_BYTE_LETTERS))])
        size = np.array([len(x) for x in found], np.int64)
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
        start = len(self.first) - 1
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        keys = np.concatenate([self.keys, keys])
        at = np.concatenate([self.at, start + np.arange(len(found))])
        order = np.argsort(keys)
        self.keys, self.at = keys[order], at[order]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's first id (n + 1 numbers)."""
        starts, ends, first = W.word_spans(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        low = W.LOWER_AZ[buf]
        kind = _KIND[buf]
        # Latin-1 letters, two bytes from 0xC3 on, are letters; the capitals among them become small.
        lead = np.flatnonzero(buf[:-1] == 0xC3)
        lead = lead[(buf[lead + 1] >= 0x80) & (buf[lead + 1] <= 0xBF) & ~np.isin(buf[lead + 1], (0x97, 0xB7))]
        kind[lead] = kind[lead + 1] = 1
        capital = lead[buf[lead + 1] <= 0x9E] + 1
        low[capital] += 0x20
        kind[np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))] = 9  # "<|" may begin a special token
        size = ends - starts
        odd_word = np.maximum.reduceat(kind, np.stack([starts, np.minimum(ends, len(kind) - 1)], 1).reshape(-1))[::2] == 9
        if ends[-1] == len(kind):  # the last word ends the buffer
            odd_word[-1] = (kind[starts[-1] :] == 9).any()
        # Tokens of the plain path: runs of letters, single digits, runs of signs. An odd word is one span.
        word = np.repeat(np.arange(len(starts)), size)
        byte = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
        k = kind[byte]
        head = np.ones(len(byte), bool)
        head[1:] = (word[1:] != word[:-1]) | (~odd_word[word[1:]] & ((k[1:] != k[:-1]) | (k[1:] == 2)))
        head = np.flatnonzero(head)
        s = byte[head]
        e = np.append(byte[head[1:] - 1], byte[-1]) + 1
        odd = odd_word[word[head]]
        text = np.where(np.repeat(odd, np.diff(np.append(head, len(byte)))), buf[byte], low[byte])
        span_at = np.append(head, len(byte))
        h = W.span_hashes(text, span_at[:-1], span_at[1:]) ^ odd.astype(np.uint64)
        keys, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = (place < len(self.keys)) & (self.keys[np.minimum(place, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        if (~known).any():
            if len(self.keys) > self.keep:  # a bound on memory only: forgotten words are encoded again
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            raw, at = text.tobytes().decode("latin-1"), sample[new]
            self._learn(keys[new], [raw[a:b] for a, b in zip(span_at[at].tolist(), span_at[at + 1].tolist(), strict=True)], odd[at])
            place = np.searchsorted(self.keys, keys)
        entry = self.at[place][inverse]
        count = self.first[entry + 1] - self.first[entry]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.arange(total[-1]) - np.repeat(total[:-1] - self.first[entry], count)]
        doc_span = np.searchsorted(s, offsets)
        return ids, total[doc_span]


def _cuts(n: int, length: int) -> list[tuple[int, int]]:
    return [(i, min(length, n - i)) for i in range(0, n, length)]


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 1, keep_ids: bool = False, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: one row per piece of every document."""
    fields = "struct<start:bigint,length:bigint,ids_crc32:bigint" + (",ids:array<int>>" if keep_ids else ">")

    @F.arrow_udf(f"array<{fields}>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = WordTokenizer(tokenizer_path)
        for column in batches:
            buf, offsets = W.text_buffer(column)
            rows, sizes = [], []
            for lo, hi in W.slices(offsets):
                ids, first = tok.encode(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for a, b in zip(first[:-1], first[1:], strict=True):
                    own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    cuts = _cuts(len(own), length)
                    sizes.append(len(cuts))
                    rows += [(i, n, zlib.crc32(own[i : i + n].tobytes()), own[i : i + n] if keep_ids else None) for i, n in cuts]
            cols = [pa.array([r[j] for r in rows], pa.int64()) for j in range(3)]
            names = ["start", "length", "ids_crc32"]
            if keep_ids:
                cols.append(pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            flat = pa.StructArray.from_arrays(cols, names)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)

    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces(F.col(text))).alias("piece", "p"))
    return out.select("doc_id", F.col("piece").cast("int").alias("piece"), "p.*")


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; pieces of one length are used in the given order."""
    n = len(lengths)
    order = np.argsort(lengths, kind="stable")
    start = np.searchsorted(lengths[order], np.arange(size + 2))
    left = np.diff(start)
    used = start[:-1].copy()
    lengths_at = np.arange(size + 1)
    # below[g]: the longest length with pieces left that is at most g; 0 if there is none.
    below = np.maximum.accumulate(np.where(left > 0, lengths_at, 0))
    bins, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def take(x: int) -> None:
        left[x] -= 1
        if not left[x]:  # gaps from x up to the next length present now fall to the length below x
            end = x + int(np.argmax(below[x:] != x)) if below[-1] != x else size + 1
            below[x:end] = below[x - 1]

    def put_back(x: int) -> None:
        left[x] += 1
        if left[x] == 1:
            part = below[x:]
            part[part < x] = x

    number = 0
    while below[size]:
        gap, own = size, []
        while gap and below[gap]:
            x = int(below[gap])
            take(x)
            own.append(x)
            gap -= x
        if gap and len(own) > 1:
            small = own.pop()
            wide = gap + small
            put_back(small)
            first = lengths_at[1 : wide // 2 + 1]
            first = first[left[first] > 0]
            if len(first):
                second = below[wide - first]
                # Two of one length need two pieces of it; second is at least first, as first <= wide / 2.
                single = (second == first) & (left[first] < 2)
                sums = np.where(single, 0, first + second)
                best = int(np.argmax(sums))
                chosen = [int(second[best]), int(first[best])] if sums[best] > small else [small]
            else:
                chosen = [small]
            for x in chosen:
                take(x)
            own += chosen
        at = 0
        for x in own:
            row = order[used[x]]
            used[x] += 1
            bins[row], offset[row] = number, at
            at += x
        number += 1
    return bins, offset


def pack(pieces: DataFrame, length: int = 4096, rows_per_block: int = 65_536) -> DataFrame:
    """pieces (doc_id, piece, length and more columns) with sequence_id and offset."""
    pieces = written(pieces)
    blocks = max(1, -(-pieces.count() // rows_per_block))
    dealt = pieces.withColumn("__block", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(blocks)).cast("int"))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def run(key: tuple, block: pa.Table) -> pa.Table:
        block = block.drop_columns(["__block"]).sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        bins, offset = best_two_fit(block["length"].to_numpy(), length)
        block = block.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 40)))
        return block.append_column("offset", pa.array(offset))

    return dealt.groupBy("__block").applyInArrow(run, schema)
