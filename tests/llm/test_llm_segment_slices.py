import numpy as np
import pytest

from candlewright.llm import segment as S
from candlewright.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    words = "the market 市場 moves 😀 ▁ up and down slowly incomprehensibly ͸".split(" ")
    return ["", "a", "͸", *[" ".join(rng.choice(words, n)) for n in (1, 5, 70, 2000)], "x" * 300]


@pytest.fixture(scope="module")
def slice_(texts):
    raw = [t.encode() for t in texts]
    return S._Slice(S.vocabulary(tokenizer_file("piece_bpe_32k.model")), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.arange(len(raw)).astype(np.uint64))


def test_exits_of_all_walks_equal_every_element_drawn(slice_):
    s, lat = slice_, slice_.lattice
    words = np.arange(len(s.number))
    edges, taken = s.walk(words, lat.first[s.type[words]], np.zeros(len(words), np.int64), 1)
    docs = len(s.offsets) - 1
    hi = np.cumsum(np.bincount(s.doc, taken, docs)).astype(np.int64)
    lo, sums = np.concatenate([[0], hi[:-1]]), np.concatenate([[0.0], np.cumsum(lat.logp[edges])])
    offset, begin, bound, noise = np.arange(docs) * 3, -0.5 * np.arange(docs), np.linspace(-1, 2, docs), S._base(s.keys, 1, 2)
    best, place = S._exits(lat, edges, sums, lo, hi, offset, begin, bound, noise, 2)
    for d in range(docs):
        edge, element = edges[lo[d] : hi[d]], np.arange(hi[d] - lo[d]) + offset[d]
        with np.errstate(all="ignore"):
            leave = np.log(np.where(lat.edges[lat.node[edge]] > 1, -np.expm1(np.minimum(lat.logp[edge], -1e-16)), 0.0))
            own = S._cut_gumbel(sums[lo[d] : hi[d]] + (begin[d] - sums[lo[d]]) + leave, bound[d], S._uniform(noise[d] + element.astype(np.uint64) * S._STEP))
        want = sorted([(v, j) for v, j in zip(own.tolist(), element.tolist()) if v > -np.inf], reverse=True)[:2]
        assert [(v, j) for v, j in zip(best[d].tolist(), place[d].tolist()) if v > -np.inf] == want


def test_grouped_ids_give_back_each_text(slice_, texts):
    rows = list(S._top_k(slice_, 3))
    for most in (1, 100, 1 << 20):
        seen = []
        for group in S._groups(iter(rows), most):
            ids, count = S._ids_of(slice_, [r[2] for r in group])
            for (d, *_), own in zip(group, np.split(ids, np.cumsum(count)[:-1]), strict=True):
                assert slice_.vocab.text_of(own)[0][1:].decode() == texts[d].replace("▁", " ")
                seen.append(d)
        assert seen == [r[0] for r in rows]


def test_the_vocabulary_is_read_once_per_worker():
    path = tokenizer_file("piece_bpe_32k.model")
    assert S.vocabulary(path) is S.vocabulary(path)
