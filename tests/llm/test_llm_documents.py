import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from candlewright.llm import packing, repeats, segment, sharding, shingle_join
from candlewright.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = [f"w{i}" for i in range(400)] + ["Don't", "ÉTÉ", "été,", "12.5€", "<|endoftext|>", "ﬁn", "中文", "%%%", "x|y"]


def corpus():
    """Ids, texts and sources: random prose, copies, near copies, shared passages, blanks, nulls, ties, repeated rows and a long text."""
    r = random.Random(3)
    prose = lambda n: [r.choice(VOCAB) for _ in range(n)]
    passage = prose(60)
    texts = [prose(r.randint(1, 300)) for _ in range(60)]
    base = prose(200)
    for i in range(25):  # near copies at several distances
        own = list(base)
        for at in r.sample(range(200), i // 3):
            own[at] = f"edit{i}"
        texts.append(own)
    texts += [base] * 8
    texts += [prose(40) + passage[i : i + 30 + 3 * i] + prose(20) for i in range(11)]
    texts += [["again"] * 80, prose(20_000), ["a"], ["a"], ["a", "b"], ["A", "B"], ["b", "a"]]
    rows = [(i, r.choice([" ", "  ", "\n", "\t "]).join(t), f"s{i % 3 if i % 2 else 0}") for i, t in enumerate(texts)]
    n = len(rows)
    return rows + [(n, None, None), (n + 1, "", "s1"), (n + 2, " \n\t ", "s1"), (n + 3, " x y", "s2"), rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 7, "clash", "clash") for r in corpus()]
    schema = "doc_id long, text string, source string, n_words int, sequence_id string, component_id string"
    return spark.createDataFrame(rows, schema).repartition(5)


def test_words_match_the_pattern():
    texts = [t or "" for _, t, _ in corpus()]
    buf, off = W.text_buffer(pa.array(texts))
    s, e, f = W.word_spans(buf, off)
    assert [[bytes(buf[s[i] : e[i]]).decode() for i in range(f[d], f[d + 1])] for d in range(len(texts))] == [WORD.findall(t) for t in texts]
    v = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64))
    assert (W.unpack_sorted(W.pack_sorted(v)) == v).all() and len(W.unpack_sorted(W.pack_sorted(v[:0]))) == 0


@pytest.mark.parametrize("window", [35, 4])
def test_repeats_against_brute_force(docs, window):
    rows = corpus()
    count = Counter()
    for _, t, _ in rows:
        w = WORD.findall(t or "")
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = Counter()
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for a in range(len(w) - window + 1):
            if count[tuple(w[a : a + window])] > 1:
                keep[a : a + window] = [False] * window
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        want[(i, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    out = repeats.remove_repeats(docs, window=window, keep_text=True)
    assert {"source", "sequence_id"} <= set(out.columns)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, " ".join(WORD.findall(r.text or ""))) for r in out.collect()) == want
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def sets_of(rows, k):
    out = []
    for _, t, _ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("k", "p", "block"), [(4, 85, 1000), (5, 80, 3), (2, 50, 1000)])
def test_shingle_join_against_brute_force(docs, k, p, block):
    rows = corpus()
    sets = sets_of(rows, k)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= p * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    lowest = {}
    for i, (d, _, _) in enumerate(rows):
        lowest[find(i)] = min(d, lowest.get(find(i), d))
    want = Counter((d, len(s), lowest[find(i)]) for i, ((d, _, _), s) in enumerate(zip(rows, sets, strict=True)))
    got = Counter(tuple(r) for r in shingle_join.join_documents(docs, k=k, threshold=(p, 100), block=block).collect())
    assert got == want
    if block == 3:
        assert shingle_join.join_documents(docs.limit(0)).count() == 0


def test_shingle_join_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (4, "a b c d e"), (None, None)], "doc_id long, text string")
    got = Counter(tuple(r) for r in shingle_join.join_documents(df).collect())
    assert got == Counter({(None, 2, None): 2, (4, 2, None): 1, (None, 0, None): 1})


def test_pieces_and_packing(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    size = 512
    out = packing.pack(packing.token_pieces(docs, path, length=size), length=size).collect()
    want = Counter()
    for d, t, _ in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), size)):
            own = ids[at : at + size]
            want[(d, n, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    assert len(bins) <= 1.05 * sum(r.length for r in out) / size + 1
    assert packing.pack(packing.token_pieces(docs.limit(0), path)).count() == 0


def test_best_two_fit_replaces_the_smallest():
    # Greedy fills 6 + 3 of 10; the pair 2 + 2 closes the gap of 4 that the 3 leaves.
    bins, offset = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 0] and sorted(offset[[0, 2, 3]].tolist()) == [0, 6, 8]
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 33, rng.integers(0, 200))
        bins, offset = packing.best_two_fit(lengths, 32)
        for b in np.unique(bins):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offset[own])]
            assert (np.cumsum(lengths[own]) - lengths[own] == offset[own]).all() and lengths[own].sum() <= 32


@pytest.mark.parametrize("per_part", [20_000, 7])
def test_interleaving_holds_the_mixture(docs, per_part):
    out = sharding.interleave(docs, shards=8, rows_per_part=per_part).collect()
    rows = corpus()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s) for d, t, s in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.source) for r in out) == want
    shards = [[r for r in out if r.shard == i] for i in range(8)]
    sizes = [len(s) for s in shards]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards)
    for source in {s for _, _, s in rows}:
        share = sum(1 for r in rows if r[2] == source) / 8
        assert all(abs(sum(r.source == source for r in s) - share) <= 2 for s in shards)
    assert sharding.interleave(docs.limit(0)).count() == 0 and sharding.interleave(docs.limit(3)).count() == 3


def test_interleaving_does_not_depend_on_parts_or_partitions(docs):
    a = sharding.interleave(docs, rows_per_part=7).select("doc_id", "shard", "slot")
    b = sharding.interleave(docs.repartition(2), rows_per_part=20_000).select("doc_id", "shard", "slot")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def every_segmentation(vocab, text):
    raw, index, out = (" " + text).encode(), {p: i for i, p in enumerate(vocab.pieces) if p and i > 258}, []

    def go(rest, ids, weight):
        if not rest:
            out.append((tuple(ids), weight))
        for n in range(1, len(rest) + 1):
            if rest[:n] in index:
                go(rest[n:], [*ids, index[rest[:n]]], weight + vocab.weight[index[rest[:n]]])
        if rest:
            c = 1 + (rest[0] >= 0xC0) + (rest[0] >= 0xE0) + (rest[0] >= 0xF0)
            if rest[:c] not in index:
                go(rest[c:], [*ids, *(3 + b for b in rest[:c])], weight - math.log(len(vocab.pieces)) * c)

    go(raw, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in out])
    return {i: w - total for i, w in out}


def test_gumbel_samples_follow_the_distribution():
    vocab, n, text = segment.Vocabulary(MODEL), 6000, "abé\nis"
    exact = every_segmentation(vocab, text)
    buf, off = W.text_buffer(pa.array([text] * n))
    s = segment._Slice(vocab, buf, off, np.arange(n).astype(np.uint64))
    first, second, mass, seen = Counter(), Counter(), 0.0, {}
    for d, i, path, log_prob, perturbed, score in segment._top_k(s, 3):
        ids = tuple(segment._ids(s, path))
        assert abs(exact[ids] - log_prob) < 1e-9
        assert ids not in seen.setdefault(d, {}) and all(perturbed <= v for v in seen[d].values())
        seen[d][ids] = perturbed
        mass += math.exp(log_prob - score)
        (first if i == 1 else second if i == 2 else Counter())[ids] += 1
    assert abs(mass / n - 1) < 0.02  # inclusion scores weigh samples to an unbiased total
    for ids, p in exact.items():
        p = math.exp(p)
        assert abs(first[ids] / n - p) < 4 * math.sqrt(p / n) + 2 / n
        q = sum(math.exp(o) * p / (1 - math.exp(o)) for x, o in exact.items() if x != ids)
        assert abs(second[ids] / n - q) < 4 * math.sqrt(q / n) + 2 / n


def test_segmentations_of_a_table(docs):
    out = segment.encode_top_k(docs, MODEL, k=3, keep_ids=True)
    got = out.select("doc_id", "sample", "ids", "log_inclusion", "round_trip", segment.decode(out["ids"], MODEL).alias("back")).collect()
    texts = dict((d, t or "") for d, t, _ in corpus())
    assert all(r.round_trip and r.back == texts[r.doc_id] and r.log_inclusion <= 0 for r in got)
    per = Counter(r.doc_id for r in got)
    blank = [d for d, t in texts.items() if not t]
    assert all(per[d] == 1 for d in blank) and per[0] == 3 and set(per) == set(texts)
    of = {}
    for r in got:
        of.setdefault((r.doc_id, tuple(r.ids)), []).append(r.sample)
    repeats_of = Counter(d for d, _, _ in corpus())
    assert all(len(v) == repeats_of[d] for (d, _), v in of.items())  # different segmentations; repeated rows alike
    again = segment.encode_top_k(docs.repartition(2), MODEL, k=3)
    assert sorted((r.doc_id, r.sample, r.ids_crc32) for r in again.collect()) == sorted((r.doc_id, r.sample, r.ids_crc32) for r in out.collect())
    assert segment.encode_top_k(docs.limit(0), MODEL).count() == 0
