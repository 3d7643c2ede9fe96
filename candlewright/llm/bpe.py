"""Byte-level BPE encoding by segment trees over adjacent pair ranks, and decoding.

A text is cut at the vocabulary's added tokens, then into words by the byte-level splitting rule. Each
different word of a task is encoded once. Over the places of a word stands a segment tree: a leaf holds
the merge rank of the pair that starts there, joined with its place, and an inner node the smaller of
its two. The root is therefore the leftmost pair of lowest rank. It is merged, the leaves of the merged
place, of the place that vanished and of the place before are set anew, and only their paths to the
root are worked out again; this goes on until the root holds no pair.

Words are processed many at once: those of one power-of-two width form a matrix of trees, and one round
merges every word's root. Words above WIDE bytes (runs without a space) use the same tree one by one:
n places cost about n log n steps.

Decoding joins the bytes of the ids; bytes that are not UTF-8 become U+FFFD, ids outside the vocabulary
are left out, special tokens stay.

The vocabulary must be a byte-level BPE file without normaliser, prefix space, dropout, unknown token or
affixes; others are refused. There is no shuffle: one pass over the texts, and a task keeps at most
`keep` different words.

Cases: null and empty texts have no ids; null id lists decode to the empty text. Texts are read whole.
Repeated rows are encoded like any other; an empty table gives an empty result. A column of the output's
name is replaced, others stay.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(2**62)
#: Widest words encoded as rows of a matrix.
WIDE = 64
#: Characters of text whose words are looked up together, and ids decoded together.
SLICE, ID_SLICE = 1 << 19, 1 << 16


def _class_of(top: int, kind: str) -> str:
    """The characters up to top of a general category, as ranges for a character class."""
    ranges: list[list[int]] = []
    for c in range(top + 1):
        if unicodedata.category(chr(c))[0] == kind:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


#: Characters with the property White_Space, fixed by Unicode.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@cache
def splitter(top: int = sys.maxunicode):
    """Words of a text whose characters go up to top, by the byte-level rule: contractions, then letters, numbers or other signs after an optional space, then white space."""
    letter, number, s = _class_of(top, "L"), _class_of(top, "N"), WHITE_SPACE
    return re.compile(rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{s}{letter}{number}]+|[{s}]+(?![^{s}])|[{s}]+").findall


def split(text: str) -> list[str]:
    """Words by the smallest classes that hold the text's characters: a class above the basic plane is a long list to search."""
    if text.isascii():
        return splitter(0x7F)(text)
    return splitter(0xFFFF if len(text.encode("utf-16-le")) == 2 * len(text) else sys.maxunicode)(text)


def byte_letters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 is itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [other.get(b, chr(b)) for b in range(256)]


class Vocabulary:
    """Pair ranks, the ids that merges give, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or spec["normalizer"] or odd:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary {odd}")
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.pairs = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        back = {c: b for b, c in enumerate(letters)}
        data = [b""] * self.size
        for token, i in vocab.items():
            data[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            data[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where they do not merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)


def merge_matrix(v: Vocabulary, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of n words, given as byte ids in an n x width matrix (width a power of two), and the mask of places left."""
    n, width = ids.shape
    step = width + 1
    row = np.arange(n)
    ids = np.concatenate([ids, np.zeros((n, 1), np.int64)], 1).ravel()
    after = np.tile(np.arange(1, step + 1), n)  # the place after each; `width` and more: none
    after.reshape(n, step)[np.arange(step)[None, :] >= (size - 1)[:, None]] = width
    before = np.tile(np.arange(-1, width), n)
    alive = np.arange(step)[None, :] < size[:, None]
    tree = np.full((n, 2 * width), NONE)
    place = np.arange(width - 1)
    wide = ids.reshape(n, step)
    rank = v.rank(wide[:, :-2], wide[:, 1:-1])
    tree[:, width : 2 * width - 1] = np.where((place[None, :] < (size - 1)[:, None]) & (rank < NONE), rank * width + place, NONE)
    half = width
    while half > 1:
        half //= 2
        tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
    tree, gone = tree.ravel(), []
    row = row[tree[row * 2 * width + 1] < NONE]
    while len(row):
        root, base, top = tree[row * 2 * width + 1], row * step, row * 2 * width
        at = root % width
        second = after[base + at]
        third, prior = after[base + second], before[base + at]
        ids[base + at] = v.made[root // width]
        after[base + at] = third
        before[base + third] = at  # of the spare place where there is no third
        gone.append(base + second)
        here, back = third < width, prior >= 0
        new = np.full((3, len(row)), NONE)
        rank = v.rank(ids[(base + at)[here]], ids[(base + third)[here]])
        new[0, here] = np.where(rank < NONE, rank * width + at[here], NONE)
        rank = v.rank(ids[(base + prior)[back]], ids[(base + at)[back]])
        new[2, back] = np.where(rank < NONE, rank * width + prior[back], NONE)
        node = np.stack([at, second, np.where(back, prior, second)]) + width
        tree[top[None, :] + node] = new
        while node[0, 0] > 1:
            node >>= 1
            child = top[None, :] + 2 * node
            tree[top[None, :] + node] = np.minimum(tree[child], tree[child + 1])
        row = row[tree[top + 1] < NONE]
    for x in gone:
        alive.ravel()[x] = False
    return ids.reshape(n, step)[:, :width], alive[:, :width]


def merge_word(v: Vocabulary, ids: list[int]) -> list[int]:
    """Token ids of one word of any length, given as byte ids."""
    n, pairs, size = len(ids), v.pairs, v.size
    width = 1 << max(n - 1, 0).bit_length()
    none = int(NONE)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    tree = [none] * (2 * width)

    def leaf(i: int, j: int) -> int:
        rank = pairs.get(ids[i] * size + ids[j])
        return none if rank is None else rank * width + i

    for i in range(n - 1):
        tree[width + i] = leaf(i, i + 1)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    made = v.made
    while width > 1 and tree[1] != none:
        rank, at = divmod(tree[1], width)
        second = after[at]
        third, prior = after[second], before[at]
        ids[at], ids[second] = int(made[rank]), -1
        after[at], before[third] = third, at
        for place, value in ((at, leaf(at, third) if third < n else none), (second, none), (prior, leaf(prior, at) if prior >= 0 else none)):
            if place < 0:
                continue
            k = width + place
            tree[k] = value
            while k > 1:
                k >>= 1
                best = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == best:
                    break
                tree[k] = best
    return [i for i in ids if i >= 0]


class Encoder:
    """Token ids of whole texts; remembers the words it has seen."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 100_000) -> None:
        self.v = vocabulary
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, appended to the store in order."""
        raw = [w.encode() for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        data = self.v.first[np.frombuffer(b"".join(raw), np.uint8)]
        start = np.cumsum(size) - size
        found_ids, found_word, found_place = [], [], []
        width = 1
        while width <= WIDE:
            mine = np.flatnonzero((size <= width) & (size > width // 2))
            for lo in range(0, len(mine), 1 << 14):
                w = mine[lo : lo + (1 << 14)]
                place = np.arange(width)[None, :]
                ids = data[np.minimum(start[w][:, None] + place, len(data) - 1)]
                alive = np.ones((len(w), 1), bool)
                if width > 1:
                    ids, alive = merge_matrix(self.v, np.where(place < size[w][:, None], ids, 0), size[w])
                r, p = np.nonzero(alive)
                found_ids.append(ids[r, p])
                found_word.append(w[r])
                found_place.append(p)
            width *= 2
        for w in np.flatnonzero(size > WIDE).tolist():
            ids = merge_word(self.v, data[start[w] : start[w] + size[w]].tolist())
            found_ids.append(np.array(ids, np.int64))
            found_word.append(np.full(len(ids), w))
            found_place.append(np.arange(len(ids)))
        ids, word, place = (np.concatenate(x) for x in (found_ids, found_word, found_place))
        order = np.lexsort((place, word))
        self.ids = np.concatenate([self.ids, ids[order].astype(np.int32)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(word, minlength=len(words)))])

    def _special(self, token: str) -> str:
        """The store's name of an added token: no word has it, as texts are cut at the token itself."""
        name = "\0" + token
        if name not in self.known:
            self.known[name] = len(self.first) - 1
            self.ids = np.append(self.ids, np.int32(self.v.added[token]))
            self.first = np.append(self.first, self.first[-1] + 1)
        return name

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        parts = self.v.parts
        if len(self.known) > self.keep:
            self._forget()
        flat: list[str] = []
        cuts = [0]
        for text in texts:
            if text and parts is not None and any(t in text for t in self.v.added):
                for i, piece in enumerate(parts.split(text)):
                    flat += [self._special(piece)] if i % 2 else split(piece)
            elif text:
                flat += split(text)
            cuts.append(len(flat))
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        known = self.known
        new = [w for w in set(flat) if w not in known]
        if new:
            start = len(self.first) - 1
            self._learn(new)
            known.update(zip(new, range(start, start + len(new)), strict=True))
        at = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        each = (self.first[1:] - self.first[:-1])[at]
        total = np.concatenate([[0], np.cumsum(each)])
        return self.ids[np.repeat(self.first[at] - total[:-1], each) + np.arange(total[-1])], np.diff(total[cuts])


@cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(_vocabulary(path))


def _slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    yield lo, len(sizes)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the token ids of each whole text."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(path)
        for column in batches:
            texts = column.to_pylist()
            ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for lo, hi in _slices([len(t or "") for t in texts], SLICE):
                x, n = encoder.encode(texts[lo:hi])
                ids.append(x)
                counts.append(n)
            first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            yield pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))

    return docs.withColumn(out, run.asNondeterministic()(F.col(text)))


def decode_ids(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The text of each list of ids (all lists one after the other)."""
    good = (ids >= 0) & (ids < v.size)
    ids = np.where(good, ids, 0).astype(np.int64)
    size = np.where(good, v.starts[ids + 1] - v.starts[ids], 0)
    total = np.concatenate([[0], np.cumsum(size)])
    data = v.bytes[np.repeat(v.starts[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
    cuts = total[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with the text of each id list, special tokens included."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = _vocabulary(path)
        for column in batches:
            found: list[str] = []
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(counts)])
            for lo, hi in _slices(counts.tolist(), ID_SLICE):
                found += decode_ids(v, flat[first[lo] : first[hi]], counts[lo:hi])
            yield pa.array(found, pa.string())

    return tokens.withColumn(out, run(F.col(ids)))
