"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A segmentation of a text is a path through the lattice of vocabulary pieces; its probability is the
product of the piece weights over the lattice's total. Adding Gumbel noise to the log-probability of
every segmentation and taking the k largest draws k different ones without replacement. The noise is
never drawn per segmentation: an A-star search pops the set of paths with the largest perturbed
maximum, samples the path that attains it, and puts back the sets of all paths that leave it at one
of its nodes, each with the maximum of its own noise, a Gumbel variable cut off at the popped value.
So the first sample costs one walk through the lattice and each further one costs the walk from the
node where it leaves an earlier sample.

A sample's inclusion score is log(1 - exp(-exp(log_prob - threshold))), the log-probability of being
among the k given the perturbed value of the (k + 1)-th, as used in importance weights.

No piece spans a word's first space, so a text's lattice is the chain of its words' lattices: they
are built once for each different word of a slice of texts, with backward sums in numpy, and walks
advance in step over all words of the slice. The noise is a hash of (seed, row key, sample, word,
step) and thus the same however rows are batched.

Weights: a model of type unigram has log-probabilities as scores. A BPE model has merge ranks, which
stand for frequency order; its piece of rank r gets weight -log(1 + r) (Zipf's law). Bytes get
-log(vocabulary size). The file's bytes are normalised as the model asks: one space is put before a
text that is not empty, and white space is kept.

Cases: a null or empty text has one segmentation, of no pieces. With fewer than k segmentations all
are returned and their inclusion score is 0 (certain). Texts are read whole, long words included.
Repeated rows get the same samples. A null key counts as 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.llm import words as W

SPACE = 32
_LOWER_ONE_EIGHTH = "▁".encode()


class Vocabulary:
    """Pieces as bytes (a space for the word mark), their weights, and a table of all prefixes by length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_first = next((i for i in range(n) if model.is_byte(i)), None)
        ranked = any(model.get_score(i) < -1000 for i in range(n))
        self.pieces = [b""] * n
        weight = np.full(n, -np.log(n))
        prefixes: list[dict[int, int]] = []
        for i in range(n):
            if model.is_byte(i):
                self.pieces[i] = bytes([i - self.bytes_first])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw = self.pieces[i] = model.id_to_piece(i).replace("▁", " ").encode()
                weight[i] = -np.log1p(-model.get_score(i)) if ranked else model.get_score(i)
                if b" " in raw.lstrip(b" "):
                    raise ValueError("a piece spans two words")
                h = 0
                for length, byte in enumerate(raw):
                    if length == len(prefixes):
                        prefixes.append({})
                    h = (h + int(W._BYTE[byte]) * pow(int(W._BASE), length, 2**64)) % 2**64
                    prefixes[length].setdefault(h, -1)
                prefixes[len(raw) - 1][h] = i
        self.weight = weight
        self.levels = []
        for level in prefixes:
            keys = np.array(sorted(level), np.uint64)
            self.levels.append((keys, np.array([level[int(x)] for x in keys], np.int64)))
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(self.pieces), np.uint8)

    def text_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes that the ids stand for, and the place after each id's."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(int(size.sum())) - np.repeat(ends - size - self.start[ids], size)
        return self.raw[at].tobytes(), ends


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """Read once per Python worker."""
    return Vocabulary(path)


class Lattice:
    """Edges of the lattices of a list of words (spans of one buffer), with their probability given the node they leave."""

    def __init__(self, vocab: Vocabulary, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        self.first = np.cumsum(size) - size
        n = int(size.sum())
        byte = buf[np.arange(n) - np.repeat(self.first - starts, size)]
        left = np.repeat(self.first + size, size) - np.arange(n)  # bytes from a node to its word's end
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        active, h, power = np.arange(n), np.zeros(n, np.uint64), np.ones(1, np.uint64)
        width = 1 + (byte >= 0xC0).astype(np.int8) + (byte >= 0xE0) + (byte >= 0xF0)
        alone = (byte & 0xC0) != 0x80  # characters without a piece of their own
        for level, (keys, ids) in enumerate(vocab.levels):
            inside = left[active] > level
            active, h = active[inside], h[inside]
            if not len(active):
                break
            h = h + W._BYTE[byte[active + level]] * power
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            active, h, piece = active[hit], h[hit], ids[place[hit]]
            full = piece >= 0
            found.append((active[full], level + 1, piece[full]))
            alone[active[full & (width[active] == level + 1)]] = False
            power = power * W._BASE
        # Those are spelled in bytes.
        alone = np.flatnonzero(alone)
        for size_ in (1, 2, 3, 4):
            own = alone[width[alone] == size_]
            found.insert(0, (own, size_, np.full(len(own), -1)))
        # Edges of a node stand together, long ones first: they are likely, so a draw looks at few edges.
        self.edges = np.zeros(n + 1, np.int64)
        for node, _, _ in found:
            self.edges[node] += 1
        self.head = np.cumsum(self.edges) - self.edges
        total = int(self.edges.sum())
        self.node, self.piece, self.width, at = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64), self.head.copy()
        for node, size_, piece in reversed(found):
            own = at[node]
            self.node[own], self.piece[own], self.width[own] = node, piece, size_
            at[node] = own + 1
        self.far = self.node + self.width
        self.inner = self.width < left[self.node]
        weight = np.where(self.piece >= 0, vocab.weight[self.piece], -np.log(len(vocab.weight)) * self.width)
        # Backward sums, nodes nearest to their word's end first; the end itself has sum 0.
        target = np.where(self.inner, self.far, n)
        beta = np.zeros(n + 1)
        nodes = np.flatnonzero(self.edges)
        order = nodes[np.argsort(left[nodes], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, left[order][1:] != left[order][:-1], True]) if len(order) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[lo:hi]
            count = self.edges[own]
            head = np.cumsum(count) - count
            edge = np.arange(int(count.sum())) + np.repeat(self.head[own] - head, count)
            value = weight[edge] + beta[target[edge]]
            most = np.maximum.reduceat(value, head)
            beta[own] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, count)), head))
        self.logp = weight + beta[target] - beta[self.node]
        self.p = np.exp(self.logp)
        run = np.cumsum(self.p)
        self.within = run - np.repeat(run[self.head[nodes]] - self.p[self.head[nodes]], self.edges[nodes])
        self.within[self.head[nodes] + self.edges[nodes] - 1] = 2.0  # the last edge takes what rounding leaves
        self.bytes = byte

    def draw(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        edge = self.head[nodes]
        more = np.flatnonzero(u > self.within[edge])
        while len(more):
            edge[more] += 1
            more = more[u[more] > self.within[edge[more]]]
        return edge


_WORD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _base(keys: np.ndarray, sample: int, purpose: int) -> np.ndarray:
    """A hash per row for one purpose in one round."""
    return W.mix(keys ^ W.mix(np.array([16 * sample + purpose + 1], np.uint64)))


def _uniform(h: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) by hashing."""
    return ((W.mix(h) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _cut_gumbel(location: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variable at a location, given that it is at most bound."""
    return np.where(np.isneginf(location), -np.inf, -np.logaddexp(-bound, -location + np.log(-np.log(u))))


class _Slice:
    """The texts of one slice: words by type, and walks through their lattices."""

    def __init__(self, vocab: Vocabulary, buf: np.ndarray, offsets: np.ndarray, keys: np.ndarray):
        self.vocab = vocab
        raw = buf.tobytes()
        if _LOWER_ONE_EIGHTH in raw:  # the mark itself in a text means a space
            parts = [raw[a:b].replace(_LOWER_ONE_EIGHTH, b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            buf = np.frombuffer(b"".join(parts), np.uint8)
        size = np.diff(offsets)
        begins = np.cumsum(size + (size > 0))
        self.offsets = np.concatenate([[0], begins])
        text = np.full(int(self.offsets[-1]), SPACE, np.uint8)
        text[np.arange(len(buf)) + np.repeat(np.cumsum(size > 0), size)] = buf
        self.text, self.keys = text, keys
        space = text == SPACE
        head = space.copy()
        head[1:] &= ~space[:-1]
        at = self.offsets[:-1][size > 0]
        head[at] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(text))
        self.first_word = np.searchsorted(starts, self.offsets)
        self.doc = W.documents_of(self.first_word)
        self.number = np.arange(len(starts)) - self.first_word[self.doc]
        _, sample, self.type = np.unique(W.span_hashes(text, starts, ends), return_index=True, return_inverse=True)
        self.lattice = Lattice(vocab, text, starts[sample], ends[sample])

    def walk(self, words: np.ndarray, nodes: np.ndarray, steps: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from the given node of each word to its end, in order of the words, and how many each word took."""
        lat, taken = self.lattice, np.zeros(len(words), np.int64)
        h = _base(self.keys, sample, 0)[self.doc[words]] + self.number[words].astype(np.uint64) * _WORD + steps.astype(np.uint64) * _STEP
        live, parts, step = np.arange(len(words)), [], 0
        while len(live):
            edge = lat.draw(nodes, _uniform(h))
            parts.append((live, edge))
            go = np.flatnonzero(lat.inner[edge])
            step += 1
            taken[live] = step
            live, nodes, h = live[go], lat.far[edge[go]], h[go] + _STEP
        out = np.zeros(int(taken.sum()), np.int64)
        start = np.cumsum(taken) - taken
        for step, (at, edge) in enumerate(parts):
            out[start[at] + step] = edge
        return out, taken


def _exits(
    lat: Lattice, edges: np.ndarray, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, offset: np.ndarray, begin: np.ndarray, bound: np.ndarray, noise: np.ndarray, m: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Of each walk edges[lo:hi] the m largest perturbed maxima of the sets that leave it, largest first, and where they leave its path.

    A noise term is below 38, and the log-probability of what comes before falls, so elements beyond the point where it
    cannot make up for that need none drawn. The walks advance in step, a block at a time.
    """
    best, place = np.full((len(lo), m), -np.inf), np.zeros((len(lo), m), np.int64)
    at, live, block, shift = lo.copy(), np.flatnonzero(lo < hi), 64, begin - sums[lo]
    while len(live):
        count = np.minimum(hi[live] - at[live], block)
        first = np.cumsum(count) - count
        walk = np.repeat(live, count)
        i = np.arange(len(walk)) + np.repeat(at[live] - first, count)
        edge = edges[i]
        location = sums[i] + shift[walk] + np.log(np.where(lat.edges[lat.node[edge]] > 1, -np.expm1(np.minimum(lat.logp[edge], -1e-16)), 0.0))
        element = i + (offset - lo)[walk]
        own = _cut_gumbel(location, bound[walk], _uniform(noise[walk] + element.astype(np.uint64) * _STEP))
        values, places = [best[live]], [place[live]]
        for _ in range(m):
            most = np.maximum.reduceat(own, first)
            hit = np.flatnonzero(own == np.repeat(most, count))
            hit = hit[np.unique(walk[hit], return_index=True)[1]]
            values.append(most[:, None])
            places.append(element[hit][:, None])
            own[hit] = -np.inf
        values, places = np.hstack(values), np.hstack(places)
        top = np.argsort(-values, axis=1, kind="stable")[:, :m]
        best[live], place[live] = np.take_along_axis(values, top, 1), np.take_along_axis(places, top, 1)
        at[live] += count
        live = live[(at[live] < hi[live]) & (begin[live] + sums[at[live]] - sums[lo[live]] + 38 > best[live, m - 1])]
        block = min(2 * block, 1024)
    return best, place


def _top_k(s: _Slice, k: int) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """Document, sample (from 1), edges, log-probability, perturbed value and inclusion score."""
    lat, docs = s.lattice, len(s.offsets) - 1
    np.seterr(divide="ignore", invalid="ignore")  # sets without a path have the logarithm of 0
    value = -np.log(-np.log(_uniform(_base(s.keys, 0, 1))))
    paths: list[list[tuple]] = [[] for _ in range(docs)]
    #: Waiting sets of each document: perturbed maximum, path, element where they leave it, edges excluded there.
    waiting: list[list[tuple[float, int, int, tuple[int, ...]]]] = [[] for _ in range(docs)]
    # The first round walks every text from its start; later ones from where a sample leaves an earlier one.
    jobs = [(d, np.zeros(0, np.int64), np.zeros(0, np.int64), int(s.first_word[d]), -1, 0, float(value[d])) for d in range(docs)]
    for sample in range(1, k + 1):
        word, node, step = (np.array([job[j] for job in jobs], np.int64) for j in (3, 4, 5))
        inside = node >= 0  # the walk starts within the word before
        count = s.first_word[np.array([job[0] for job in jobs], np.int64) + 1] - word + inside
        first = np.cumsum(count) - count
        words = np.arange(int(count.sum())) + np.repeat(word - inside - first, count)
        nodes, steps = lat.first[s.type[words]], np.zeros(len(words), np.int64)
        nodes[first[inside]], steps[first[inside]] = node[inside], step[inside]
        edges, taken = s.walk(words, nodes, steps, sample)
        of_word = np.repeat(words, taken)
        ends = np.cumsum(np.bincount(s.doc[words], taken, docs)).astype(np.int64)
        sums = np.concatenate([[0.0], np.cumsum(lat.logp[edges])])
        noise_of, other = _base(s.keys, sample, 2), _base(s.keys, sample + 1, 3)
        again, m = [], k + 1 - sample  # at most m of a path's sets can still be popped or set the threshold
        own = np.array([job[0] for job in jobs], np.int64)
        hi = ends[own]
        lo = np.where(own > 0, ends[own - 1], 0)
        offset = np.array([len(job[1]) for job in jobs], np.int64)
        begin = np.array([lat.logp[job[1]].sum() if len(job[1]) else 0.0 for job in jobs])
        top_value, top_place = _exits(lat, edges, sums, lo, hi, offset, begin, np.array([job[6] for job in jobs]), noise_of[own], m)
        log_prob = (begin + (sums[hi] - sums[lo])).tolist()
        for (d, head, head_word, _, _, _, bound), a, b, value_, v_, j_ in zip(jobs, lo.tolist(), hi.tolist(), log_prob, top_value.tolist(), top_place.tolist(), strict=True):
            path, word_of = (np.concatenate([head, edges[a:b]]), np.concatenate([head_word, of_word[a:b]])) if len(head) else (edges[a:b], of_word[a:b])
            paths[d].append((path, word_of, value_, bound))
            best = [(v, j) for v, j in zip(v_, j_, strict=True) if v > -np.inf]
            waiting[d] += [(v, sample - 1, j, (int(path[j]),)) for v, j in best]
            if sample == k or not waiting[d]:
                continue
            top = max(waiting[d])
            waiting[d].remove(top)
            bound, source, j, out = top
            path, word_of, _, _ = paths[d][source]
            word = int(word_of[j])
            step = j - int(np.searchsorted(word_of, word))
            node = lat.node[path[j]]
            options = np.array([e for e in range(lat.head[node], lat.head[node] + lat.edges[node]) if e not in out])
            share = np.cumsum(lat.p[options])
            u = _uniform(other[d : d + 1] + np.arange(2, dtype=np.uint64))
            pick = int(options[min(int(np.searchsorted(share, u[0] * share[-1], side="right")), len(options) - 1)])
            if len(options) > 1:
                left = lat.logp[path[:j]].sum() + np.log(lat.p[options[options != pick]].sum())
                waiting[d].append((float(_cut_gumbel(np.array([left]), bound, u[1:])[0]), source, j, (*out, pick)))
            inner = bool(lat.inner[pick])
            again.append((d, np.append(path[:j], pick), word_of[: j + 1].copy(), word + 1, int(lat.far[pick]) if inner else -1, step + 1, bound))
        jobs = again
    for d in range(docs):
        threshold = max((w[0] for w in waiting[d]), default=-np.inf)
        for i, (path, _, log_prob, bound) in enumerate(paths[d]):
            x = log_prob - threshold
            score = x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700)))))
            yield d, i + 1, path, log_prob, bound, min(score, 0.0)


def _ids(s: _Slice, path: np.ndarray) -> np.ndarray:
    return _ids_of(s, [path])[0]


def _ids_of(s: _Slice, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the paths, one after another, and how many each has."""
    lat, size = s.lattice, np.array([len(x) for x in paths], np.int64)
    path = np.concatenate(paths)
    piece = lat.piece[path]
    if (piece >= 0).all():
        return piece, size
    count = np.where(piece >= 0, 1, lat.width[path])
    out = np.repeat(piece, count)
    at = np.repeat(lat.node[path] - (np.cumsum(count) - count), count) + np.arange(len(out))
    ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum(size)]
    return np.where(out >= 0, out, lat.bytes[np.minimum(at, len(lat.bytes) - 1)] + s.vocab.bytes_first), np.diff(ends, prepend=0)


def _groups(rows: Iterator[tuple], most: int = 1 << 16) -> Iterator[list[tuple]]:
    """Samples in groups of about as many elements; a longer one is a group of its own."""
    group, size = [], 0
    for row in rows:
        if group and size + len(row[2]) > most:
            yield group
            group, size = [], 0
        group.append(row)
        size += len(row[2])
    if group:
        yield group


def encode_top_k(
    docs: DataFrame, model_path: str, k: int = 2, seed: int = 5, key: str = "doc_id", text: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """Per row of docs and sample: the key, sample, n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, round_trip and, if asked for, ids."""
    fields = "struct<sample:int,n_pieces:bigint,ids_crc32:bigint,log_prob:double,perturbed:double,log_inclusion:double,round_trip:boolean" + (",ids:array<int>>" if keep_ids else ">")
    names = ["sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "round_trip"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]

    @F.arrow_udf(f"array<{fields}>")
    def samples(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        vocab = vocabulary(model_path)
        for column, row_key in batches:
            buf, offsets = W.text_buffer(column)
            row_key = row_key.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rows, ids, size = [], [], np.zeros(len(column), np.int64)
            for lo, hi in W.slices(offsets, 2 << 20):
                s = _Slice(vocab, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], row_key[lo:hi])
                original = s.text.tobytes()
                for group in _groups(_top_k(s, k)):
                    every, count = _ids_of(s, [x[2] for x in group])
                    raw, places = vocab.text_of(every)
                    ends = np.cumsum(count)
                    cuts = np.concatenate([[0], places])[np.concatenate([[0], ends])].tolist()
                    packed, bounds = every.astype("<u4").tobytes(), np.concatenate([[0], ends]).tolist()
                    for j, (d, sample, _, log_prob, perturbed, score) in enumerate(group):
                        # The space put first counts for neither.
                        same = raw[cuts[j] + 1 : cuts[j + 1]] == original[s.offsets[d] + 1 : s.offsets[d + 1]]
                        rows.append((sample, bounds[j + 1] - bounds[j], zlib.crc32(packed[4 * bounds[j] : 4 * bounds[j + 1]]), log_prob, perturbed, score, same))
                        size[lo + d] += 1
                        if keep_ids:
                            ids.append(every[bounds[j] : bounds[j + 1]].astype(np.int32))
            cols = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            if keep_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            flat = pa.StructArray.from_arrays(cols, names + ["ids"] * keep_ids)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat)

    row_key = F.xxhash64(F.lit(seed), F.col(key))
    return docs.select(F.col(key).alias(key), F.explode(samples(F.col(text), row_key)).alias("s")).select(key, "s.*")


def decode(ids: Column, model_path: str) -> Column:
    """Text of an array of ids."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for column in batches:
            yield pa.array([None if x is None else model.decode(x) for x in column.to_pylist()], pa.string())

    return text(ids)
