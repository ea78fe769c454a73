"""Periodic runs, byte-level BPE and the Merkle manifest against plain versions of themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runlens.llm import bytepairs, manifest, periodic
from runlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None, None, None, None), (None, "", "s", "en", 0), (2, "a " * 5000, "s", None, 7), (2, "a " * 5000, "s", None, 7), (3, "é<|endoftext|> \n\n x\x1c!  ", None, "", None),
       (-4, "ab cd ab cd ab cd ab cd ab cd ab cd e", "t", "en", 3), (None, None, None, "en", None), (5, "x" * 70_000, "s", "en", 70_000), (10 ** 12, " \t\n ", "s", "zz", 4)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1, "k", 2) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, n int, key string, rank int")


def runs_by_trial(w, least=12):
    """All (start, length, period), trying every period at every place."""
    found, n = {}, len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def test_runs_by_trial():
    draw = random.Random(3)
    texts = []
    for _ in range(250):
        n, letters = draw.randrange(0, 120), draw.choice([1, 2, 2, 3, 6])
        w = [draw.randrange(letters) for _ in range(n)]
        for _ in range(draw.randrange(3)):
            if n:
                a, p = draw.randrange(n), draw.randrange(1, 12)
                w[a:] = [w[a + k % min(p, n - a)] for k in range(n - a)]
        texts.append(w)
    for least in (12, 2):
        got = periodic.find_runs([np.array(w, np.int64) for w in texts], least, most=500)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [runs_by_trial(w, least) for w in texts]
    assert periodic.find_runs([]) == [] and [len(r) for r in periodic.find_runs([np.empty(0, np.int64)])] == [0]


def test_extensions_meet_the_cover():
    draw = np.random.default_rng(1)
    for letters in (1, 2, 50):
        x = np.concatenate([draw.integers(0, letters, 400), [99]])
        s = periodic.Suffixes(x)
        i, j = draw.integers(0, 401, (2, 3000))
        i, j = i[i != j], j[i != j]

        def plain(a, b):
            k = 0
            while max(a, b) + k < len(x) and x[a + k] == x[b + k]:
                k += 1
            return k
        assert s.lce(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist())]


def expected_runs(doc_id, text):
    words = [w for w in regex.split("[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    runs = runs_by_trial([number[w] for w in words])
    stay = [True] * n
    for s, length, q in runs:
        stay[s + q:s + length] = [False] * (length - q)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for w, k in zip(words, stay) if k))]
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, *sha)


def test_runs_of_documents(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter(F.length("text") < 12_000)
    both = docs.union(odd.filter("coalesce(length(text), 0) < 20000").select("doc_id", "text"))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((expected_runs(r.doc_id, r.text) for r in both.collect()), key=repr)
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if "sha256" not in c} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and sum(r[1] for r in want) > 10
    spans = {r.doc_id: r for r in periodic.detect(odd).collect()}
    assert [tuple(r) for r in spans[2].runs] == [(0, 5000, 1)] and spans[2].collapsed == "a" and spans[-4].collapsed == "ab cd e"
    assert periodic.detect(odd.limit(0)).collect() == []


def test_white_space_and_letters_are_the_librarys():
    """Every code point between letters, digits and signs is cut as the library cuts it."""
    t, codec = Tokenizer.from_file(BPE), bytepairs.Codec(bytepairs.Vocabulary(BPE))
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 5000):
        text = "".join(f"a{c}1{c}{c}! {c}b" for c in points[a:a + 5000])
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, hex(ord(points[a]))


def test_merges_by_rescanning():
    v, draw, words = bytepairs.Vocabulary(BPE), random.Random(2), []

    def plain(s):
        s = list(s)
        while True:
            ranked = [(v.ranks[a << 32 | b] >> 32, i) for i, (a, b) in enumerate(zip(s, s[1:])) if a << 32 | b in v.ranks]
            if not ranked:
                return s
            rank, i = min(ranked)
            s[i:i + 2] = [v.made[rank]]

    for _ in range(400):
        word = "".join(draw.choice(["the", "ing", "a", "aa", " ", "é", "日", "zq", "1", "=="]) for _ in range(draw.randrange(25)))
        symbols = [v.single[b] for b in word.encode()]
        assert bytepairs.merged(symbols, v) == plain(symbols)
        words.append((word.encode(), plain(symbols)))
    for leaves in (1, 4, 8, 64):
        those = [(w, ids) for w, ids in words if 2 <= len(w) <= leaves + 1]
        assert [np.frombuffer(x, "<u4").tolist() for x in bytepairs.merged_together([w for w, _ in those], leaves, v)] == [ids for _, ids in those] and len(those) > 5


def test_byte_bpe_is_the_librarys(spark, odd, tmp_path):
    t = Tokenizer.from_file(BPE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = QUERIES["op12_byte_bpe"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    texts = bytepairs.decode_table(bytepairs.encode_table(odd, BPE), BPE).collect()
    assert sorted((r.doc_id, r.text) for r in texts if r.doc_id) == sorted((r[0], r[1] or "") for r in ODD if r[0])
    assert bytepairs.encode_table(odd.limit(0), BPE).collect() == []


def test_codec_forgets_and_takes_broken_ids():
    t, codec = Tokenizer.from_file(BPE), bytepairs.Codec(bytepairs.Vocabulary(BPE), remember=5, longest=6)
    for text in ("one two three four five six seven", "a" * 3000, "<|endoftext|><|endoftext|> <|end", " lead", "trail \n ", "\n\n\n x  y", "don't we'll 12's"):
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids and codec.decode(codec.encode([text])[0]) == text
        assert len(codec.chunks.older) + len(codec.chunks.now) <= 60 and all(len(k) <= 6 for k in codec.chunks.older)
    ids = [codec.v.single[b] for b in "é日".encode()][1:-1]
    assert codec.decode(np.array(ids, "<u4").tobytes()) == t.decode(ids)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def own_leaf(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(level, fan=2):
    """(root, siblings by leaf) of a list of digests."""
    sides, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // fan * fan:i // fan * fan + fan]
            sides[k].append(("".join(run[:i % fan]), "".join(run[i % fan + 1:])))
        at, level = [i // fan for i in at], [h(*level[i:i + fan]) for i in range(0, len(level), fan)]
    return level[0], sides


def expected_manifest(rows, fan=2):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    names = sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    subroots, inner = [], {}
    for g in names:
        some = sorted(groups[g], key=lambda r: (r.doc_id is not None, r.doc_id or 0, own_leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text)))
        leaves = [own_leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in some]
        root, sides = climb(leaves, fan)
        subroots.append(root)
        inner[g] = some, leaves, sides
    if not names:
        return
    root, over = climb(subroots, fan)
    for g, top, more in zip(names, subroots, over):
        for r, leaf, side in zip(*inner[g]):
            tampered = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 0 and r.n_chars is not None
            now = own_leaf(r.doc_id, r.source, r.lang, r.n_chars + 1, r.text) if tampered else leaf
            for before, after in side + more:
                now = h(before, now, after)
            yield (r.doc_id, leaf, top, root, h(*[x for s in side + more for x in s]), now, now == root)


@pytest.mark.parametrize("fan,band", [(2, 6), (2, 2), (3, 2)])
def test_manifest(spark, odd, tmp_path, fan, band):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars").unionByName(odd.select("doc_id", "text", "source", "lang", "n_chars"))
    want = sorted(expected_manifest(docs.collect(), fan), key=repr)
    if (fan, band) == (2, 6):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        got = QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    else:
        got = manifest.verify(docs, F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 0, fan, band)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 3


def test_manifest_of_few_rows(spark, odd):
    for rows in (odd.limit(0), odd.filter("doc_id = 1"), odd.filter("doc_id = 2"), odd.filter("doc_id IN (1, 5)")):
        got = manifest.verify(rows, F.lit(False))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((*r[:5], r[3], True) for r in expected_manifest(rows.collect())), key=repr)
