"""Conversation repair, segment-tree BPE and the Merkle manifest against plain versions."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from candlewright.llm import bpe, merkle, repair
from candlewright.llm.queries import QUERIES, tokenizer_file

SPACES = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Conversation repair


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [] if h == 0 else [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """Cheapest (cost, audit) over all edits by a shortest-path search on (rows read, roles put out so far as a state)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in order:
        body = text.strip(SPACES)
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(order)
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == n and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for c, r in (("u", "user"), ("a", "assistant")):
            if c in follow[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, c, (*out, f"{r}:")))
        if i < n:
            _, role, text = order[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in ("b", "d"):
                late = faults[i] == "t"
                if role[:1] in follow[state] and role:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for c, r in (("u", "user"), ("a", "assistant")):
                    if c in follow[state]:
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, c, (*out, f"{r}:{text}")))
    turns = [t for t, _, _ in order if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(order)]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": sha("\n".join(out)),
    }, list(out)


def plain_conversations(rows):
    left = {r[0]: [] for r in rows}
    for conv, *rest in plain_damage(rows):
        left[conv].append(tuple(rest))
    return {k: plain_repair(v) for k, v in left.items()}


def random_conversations(seed, n, length=7):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sage", "User"]
    texts = ["One.", "Two!", "Three", "", " \t", None, "ends \n", "why? ", "·"]
    return [(c if c else None, None if rng.random() < 0.05 else t + (rng.random() < 0.1), rng.choice(roles), rng.choice(texts)) for c in range(n) for t in range(rng.randrange(1, length))]


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_repair_against_search(spark):
    rows = random_conversations(1, 400) + random_conversations(2, 20, 40)[50:]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    damaged = repair.damaged(df)
    found = repair.report(damaged)
    got = {r["id"]: r.asDict() for r in found.collect()}
    want = plain_conversations(rows)
    assert got.keys() == want.keys()
    for key, (line, _) in want.items():
        assert {k: got[key][k] for k in line} == line, (key, [r for r in rows if r[0] == key])
    turns = {}
    for r in sorted(repair.repaired_turns(damaged, found).collect(), key=lambda r: r["place"]):
        turns.setdefault(r["id"], []).append(f"{r['role']}:{r['text']}")
    assert turns == {k: v for k, (_, v) in want.items() if v}


def test_repair_of_one_long_conversation(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "user", "assistant"]), f"text {rng.randrange(900)}" + rng.choice([".", ""])) for t in range(3000)]
    got = repair.report(repair.damaged(spark.createDataFrame(rows, CONVERSATIONS))).collect()
    want, _ = plain_repair([r[1:] for r in plain_damage(rows)])
    assert len(got) == 1 and {k: got[0][k] for k in want} == want


def test_repair_of_given_and_empty_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: r.asDict() for r in QUERIES["op11_lr_repair"](spark, "/root/testdata/sf0.01").collect()}
    want = plain_conversations(rows)
    assert got == {k: {"conv_id": k, **v} for k, (v, _) in want.items()}
    assert repair.report(repair.damaged(spark.createDataFrame([], CONVERSATIONS))).collect() == []
    gone = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = repair.report(repair.damaged(spark.createDataFrame(gone, CONVERSATIONS))).collect()
    assert gone and {(r["cost"], r["audit"], r["repaired_sha256"]) for r in got} == {(0, "", sha(""))} and len(got) == len(gone)


def test_repair_ignores_clashing_columns(spark):
    rows = random_conversations(3, 30)
    df = spark.createDataFrame(rows, CONVERSATIONS)
    clash = df.withColumns({c: F.lit(1) for c in ("id", "dropped", "fault", "seen", "h", "copy", "mark", "audit")})
    assert sorted(map(str, repair.report(repair.damaged(clash)).collect())) == sorted(map(str, repair.report(repair.damaged(df)).collect()))


# BPE

DOCS = "doc_id long, text string"
TEXTS = [
    None, "", "a", " ", "  \n\n\t x", "Hello world, it's o'clock: I'll", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "é" * 70, "ab" * 40_000, " " * 3000 + "x", "日本語テキスト 123 ½ Ⅷ",
    "\x00<|endoftext|>", "\x1c\x1d \x85　 y", "𝒜𝒷 🂡🂢 x", "the the the", "word " * 5000, "-" * 500, "'s's't're'",
]


def test_bpe_against_tokenizers(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(3)
    alphabet = [chr(c) for c in range(256)] + list("  \n''stmdrevl") * 8 + [chr(rng.randrange(0x100, 0xD000)) for _ in range(60)] + ["🙂", "𝒜"]
    texts = TEXTS * 2 + ["".join(rng.choices(alphabet, k=rng.randrange(300))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(df, path), path).collect()}
    for i, text in enumerate(texts):
        want = plain.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want, text
        assert got[i]["decoded"] == plain.decode(want, skip_special_tokens=False) == (text or "")
    assert bpe.encode(spark.createDataFrame([], DOCS), path).collect() == []


def test_bpe_decodes_any_ids(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(4)
    lists = [[rng.randrange(50_257) for _ in range(rng.randrange(30))] for _ in range(200)] + [[50_256, 188, 99], [10**6, 5], [-1, 7]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(999, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, path).collect()}
    for i, x in enumerate(lists):
        assert got[i] == plain.decode([t for t in x if 0 <= t < 50_257], skip_special_tokens=False)
    assert got[999] == ""


def test_bpe_matrix_and_single_words_agree():
    v = bpe.Vocabulary(tokenizer_file("byte_bpe_50k.json"))
    rng = random.Random(6)
    e = bpe.Encoder(v)
    words = ["".join(rng.choices("abehinorst", k=rng.randrange(1, bpe.WIDE + 1))) for _ in range(500)]
    for w in words:
        ids, _ = e.encode([w])
        assert ids.tolist() == bpe.merge_word(v, v.first[list(w.encode())].tolist())


def test_bpe_refuses_other_vocabularies():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.Vocabulary(tokenizer_file("word_bpe_49k.json"))


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op12_segment_tree_bpe"](spark, "/root/testdata/sf0.01").collect()}
    for d, enc in zip(docs, plain.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False), strict=True):
        assert got[d["doc_id"]] == (len(enc.ids), sha(",".join(map(str, enc.ids))), sha(plain.decode(enc.ids, skip_special_tokens=False)))


# Manifest


def plain_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text): a list of results in order of (source, doc_id, leaf)."""

    def leaf(r):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    def tree(nodes):
        """Root, and for each node its steps (before, after)."""
        groups, steps = [[i] for i in range(len(nodes))], [[] for _ in nodes]
        while len(nodes) > 1:
            up, joined = [], []
            for lo in range(0, len(nodes), 3):
                run = nodes[lo : lo + 3]
                for j in range(len(run)):
                    for i in groups[lo + j]:
                        steps[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
                up.append(sha("".join(run)))
                joined.append(sum(groups[lo : lo + 3], []))
            nodes, groups = up, joined
        return nodes[0], steps

    by: dict = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))):
        by.setdefault(r[1], []).append(r)
    trees = {s: tree([leaf(r) for r in group]) for s, group in by.items()}
    if not trees:
        return []
    root, tops = tree([t[0] for t in trees.values()])
    out = []
    for (s, group), top in zip(by.items(), tops, strict=True):
        for r, steps in zip(group, trees[s][1], strict=True):
            path = steps + top
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            at = leaf((*r[:4], text))
            for a, b in path:
                at = sha(a + at + b)
            out.append((r[0], leaf(r), trees[s][0], root, sha("".join(a + b for a, b in path)), at, at == root))
    return out


DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string"


def spark_manifest(spark, rows, folder, extra=()):
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(f"{folder}/documents.parquet")
    return [tuple(r) for r in QUERIES["op13_slot_pivot_manifest"](spark, str(folder)).collect()]


def test_manifest_against_plain(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, "big", "en", 3, f"t{i}\n") for i in range(2500)]
    rows += [(rng.randrange(300), rng.choice([None, "", "é", "a", "big2", "Z"]), rng.choice([None, "de"]), rng.choice([None, 5]), rng.choice([None, "", "x\ny", "long " * 3000, "ü\n"])) for _ in range(200)]
    rows += [(None, "a", None, None, "x\n")] * 3 + [(1, f"one{i}", "en", 1, "x") for i in range(40)]
    got = spark_manifest(spark, rows, tmp_path, ("grp", "place", "leaf", "path", "block", "size", "top"))
    want = plain_manifest(rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert 0 < sum(not r[6] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 729, 730])
def test_manifest_sizes(spark, tmp_path, n):
    rows = [(i, "s", None, None, f"\n{i}") for i in range(n)]
    assert sorted(spark_manifest(spark, rows, tmp_path)) == sorted(plain_manifest(rows))


def test_manifest_other_fanout(spark):
    df = spark.createDataFrame([(i, "s", "x", 1, str(i)) for i in range(70)], DOCUMENTS)
    got = merkle.manifest(merkle.leaves_of(df, F.lit(False), F.col("text")), fanout=5)
    rows = got.select("root", merkle.folded(F.col("leaf"), F.col("path")).alias("folded"), F.size("path").alias("n")).collect()
    assert {r["folded"] for r in rows} == {rows[0]["root"]} and {r["n"] for r in rows} == {3}


def test_manifest_of_given_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in QUERIES["op13_slot_pivot_manifest"](spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got) == sorted(plain_manifest(docs))
