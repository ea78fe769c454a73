"""Classifiers, packing, codes and rules against brute force and on awkward rows."""

import collections
import html
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from runlens.llm import common, compression, language, licences, packing, pages, sentencepieces, simhash, toxicity, weak_rules

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", "   ", "one", "one two three one two three one two three", "x" * 70_000, "It's <|endoftext|> ÇA 12　ΑΣ", "a\n\na\nb. Licensed under CC BY-NC 4.0.\n"]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward texts, a repeated row, a null id, and extra columns whose names operators use."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "one"), (None, "nobody's")]
    return spark.createDataFrame([(i, t, "en", 1.0, "x", 7) for i, t in rows], "doc_id long, text string, lang string, score double, y string, fp int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_operators_take_awkward_and_empty_tables(odd, labels):
    run = {
        "toxicity": lambda d: toxicity.classify(d, labels), "licences": licences.scan, "packing": lambda d: packing.pack_documents(d, WORDS),
        "compression": lambda d: compression.classify(d, labels), "simhash": simhash.near_duplicates, "rules": weak_rules.judge,
        "pieces": lambda d: sentencepieces.encode_documents(d, PIECES), "language": language.identify,
    }
    for name, fn in run.items():
        got = fn(odd).collect()
        assert collections.Counter(r.doc_id for r in got if not hasattr(r, "piece") or r.piece == 0) == collections.Counter([*range(8), 3, None]), name
        assert fn(odd.limit(0)).collect() == [], name


def test_classifiers_without_labels(odd, labels):
    assert {r.predicted for r in toxicity.classify(odd, labels.limit(0)).collect()} == {0}
    assert {r.score for r in compression.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_packing_is_gapless_and_exact(odd, docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(WORDS)
    d = docs.select("doc_id", "text").union(odd.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text").filter("doc_id <> 10000003"))
    got = packing.pack_documents(d, WORDS, open_bins=8).collect()
    at = collections.defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for held in at.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    by = {(r.doc_id, r.piece): r for r in got}
    for r in d.filter("doc_id is not null").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, start in enumerate(range(0, len(ids), 2048)):
            p, part = by[(r.doc_id, k)], ids[start:start + 2048]
            assert (p.start, p.length, p.ids_crc32) == (start, len(part), zlib.crc32(part.tobytes()))
    assert len(at) < 1.05 * sum(r.length for r in got) / 2048 + 8


def test_packing_encodes_words_as_the_library_does():
    """Every plain character beside letters, digits, signs and white space, and random mixtures, also when little is remembered."""
    from tokenizers import Tokenizer
    tokenizer, draw = Tokenizer.from_file(WORDS), random.Random(11)
    plain = [c for c in map(chr, range(0x300)) if packing.plain(c)]
    texts = [f"a{c}b {c} {c}{c}x X{c}... 7{c}' {c}***{c}, it{c}s '{c}t don't{c}" for c in plain]
    texts += ["".join(draw.choices("aAéSt7'.,*(<>\" \t\xa0\n", k=80)) for _ in range(300)] + ["", " ", "\n", "dogs' ('the rock'n'roll...' x''s", "y" * 900, "naïve こ x"]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for encode in (packing.Encoder(WORDS), packing.Encoder(WORDS, remember=50, longest=6)):
        for _ in range(2):
            assert [ids for a in range(0, len(texts), 40) for ids in encode(texts[a:a + 40])] == want
    assert encode([]) == []


def test_packing_looks_up_each_different_word_once_a_call(monkeypatch):
    asked, encoded = [], packing.Memory.encoded

    def counted(self, rows):
        asked.extend(map(len, rows))
        return encoded(self, rows)

    monkeypatch.setattr(packing.Memory, "encoded", counted)
    packing.Encoder(WORDS)([" ".join(["five", "words,", "are", "said***", "again"] * 1000)] * 4)
    assert sum(asked) <= 20


def test_bins_are_best_fit_and_bounded():
    draw, size, most = random.Random(3), 100, 5
    bins, held = packing.Bins(size, most), {}
    for _ in range(3000):
        n = draw.randrange(1, 100)
        fits = [f for f in held.values() if f >= n]
        seq, offset = bins.place(n)
        if fits:
            assert held[seq] == min(fits) and offset == size - min(fits)
        else:
            if len(held) >= most:
                held.pop(next(k for k in held if k not in {b for v in bins.by_space.values() for b in v}))
            held[seq] = size
        held[seq] -= n
        if not held[seq]:
            del held[seq]
        assert bins.open == len(held) <= most


def fingerprint(text):
    import xxhash
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, odd, docs):
    base = [(r.doc_id, r.text) for r in docs.limit(120).collect()]
    near = [(5000 + i, t + " tail") for i, t in base[:40]] + [(6000 + i, "A\tB  c É " + str(i % 3)) for i in range(30)]
    rows = base + near + [(7000 + r.doc_id, r.text) for r in odd.collect() if r.text != "one" and r.doc_id is not None]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {i: fingerprint(t) for i, t in rows}
    assert {i: f"{f:016x}" for i, f in fps.items()} == {i: r.fingerprint for i, r in got.items()}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: find(i) for i in fps} == {i: r.component_id for i, r in got.items()}


def test_links_survive_redealt_buckets(spark):
    """A ball of near fingerprints far above the bucket size: every link within two bits is found."""
    draw = random.Random(5)
    centre = draw.getrandbits(64)
    fps = sorted({simhash.signed(centre ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(4)))) for _ in range(400)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df, large=8).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & mask).bit_count() <= 2}


def test_one_of_each_keeps_columns(odd):
    got = simhash.one_of_each(odd)
    assert got.columns == odd.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None)[:2] == [0, 3] and got.count() == len({fingerprint(t) for t in [*ODD, "nobody's"]})


def test_rules_count_exactly(odd, docs):
    d = docs.select("doc_id", "text").union(odd.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    kept = 0
    for r in weak_rules.judge(d).collect():
        x = texts[r.doc_id]
        words = re.findall("[^\x20\x09-\x0D]+", x)
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        n = collections.Counter(windows)
        again = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)}
        lines = [line for line in x.split("\n") if re.search("[^\x20\x09-\x0D]", line)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words)) and not (r.kept and r.base_failed)
        kept += r.kept
    assert kept > 100


def test_rules_learn_accuracies(spark):
    """Posterior against the same estimation in plain Python."""
    draw = random.Random(2)
    rows = [tuple(draw.choice([-1, 0, 0]) for _ in weak_rules.RULES[:-1]) + (draw.choice([0, 1]),) for _ in range(500)]
    df = spark.createDataFrame(rows, ", ".join(f"{r} int" for r in weak_rules.RULES))
    got = {tuple(r)[:-1]: r.p for r in df.withColumn("p", weak_rules.estimate(df, rounds=5)).collect()}
    acc = [0.85] * len(weak_rules.RULES)

    def p(v):
        good = np.prod([a if x == 1 else 1 - a for x, a in zip(v, acc) if x])
        bad = np.prod([a if x == -1 else 1 - a for x, a in zip(v, acc) if x])
        return good / (good + bad)

    for _ in range(5):
        ps = [p(v) for v in rows]
        acc = [(sum(q if v[k] == 1 else 1 - q for v, q in zip(rows, ps) if v[k]) + 8.5) / (sum(v[k] != 0 for v in rows) + 10) for k in range(len(acc))]
    assert all(abs(got[v] - p(v)) < 1e-9 for v in rows)


def test_toxic_words_behind_disguise():
    counts = np.zeros((27, 27, 27))
    for w in "idiot loser moron pathetic stupid worthless and the ration total relation other".split() * 20:
        x = [0, *(ord(c) - 96 for c in w), 0]
        for a, b, c in zip([0, *x], x, x[1:]):
            counts[a, b, c] += 1
    decoder = toxicity.Decoder(toxicity.language_model(counts))
    for said, meant in {"you 1d10t": "idiot", "l o s e r": "loser", "m0r0n!!": "moron", "p.a.t.h.e.t.i.c": "pathetic", "stuuuupid": "stupid",
                        "s t u p 1 d": "stupid", "w0rthle$s": "worthless", "plain stupid.": "stupid"}.items():
        assert meant in decoder.restored(said), said
    assert decoder.restored("") == set()


def test_viterbi_is_the_cheapest_reading():
    draw = np.random.default_rng(1)
    costs = toxicity.language_model(draw.integers(0, 9, (27, 27, 27)).astype(float))
    decoder = toxicity.Decoder(costs)

    def readings(i, arcs, n):
        if i == n:
            yield "", 0.0
        else:
            for j, letters, more in arcs[i]:
                for rest, cost in readings(j, arcs, n):
                    yield letters + rest, more + cost

    def price(s):
        total, a, b = 0.0, 0, 0
        for c in s:
            k = toxicity.code(c)
            if k or b:
                total += costs[a][b][k]
                a, b = b, k
        return total + (costs[a][b][0] if b else 0.0)

    for s in ["1d10t", "l.0-5er", "aaab4", "x y z1", "plain", "pl00n", "aabb1a"]:
        best = min(cost + price(text) for text, cost in readings(0, list(decoder.arcs(s)), len(s)))
        found = decoder.read(s)
        assert any(abs(cost + price(text) - best) < 1e-9 and " ".join(text.split()) == found for text, cost in readings(0, list(decoder.arcs(s)), len(s)))


def test_long_stretches_are_settled_on_the_way():
    """Readings do not depend on where paths are let go, and a stretch of signs takes little memory."""
    draw = np.random.default_rng(2)
    decoder = toxicity.Decoder(toxicity.language_model(draw.integers(0, 9, (27, 27, 27)).astype(float)))
    for _ in range(40):
        s = "".join(draw.choice(list("abst10$ .-!*aaa"), draw.integers(1, 60)))
        assert decoder._read(s, every=1) == decoder._read(s, every=3) == decoder._read(s, every=10 ** 9), s
    tracemalloc.start()
    assert len(decoder._read("1d10t.!" * 30_000)) > 30_000
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_held_out_accuracy(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for got, name, least in ((toxicity.classify(d, y), "toxic", 0.9), (compression.classify(d, y), "quality", 0.93)):
        rows = got.join(y, "doc_id").filter("held_out").collect()
        assert np.mean([r.predicted == r[name] for r in rows]) >= least and all(0 <= r.score <= 1 for r in rows)
    rows = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_forward_backward_against_all_labellings():
    draw = np.random.default_rng(0)
    s, trans, start = draw.normal(size=(1, 5, 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
    p, pair, first = language.marginals(s, np.array([4]), trans, start)
    want, total = np.zeros((4, 3)), 0.0
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(start[y[0]] + sum(s[0, i, k] for i, k in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += w
        for i, k in enumerate(y):
            want[i, k] += w
    assert np.allclose(p[0, :4], want / total) and not p[0, 4].any() and np.isclose(pair.sum(), 3)


def test_words_are_letters_and_long_runs_are_pieces():
    assert language.words_in("½ ² Ⅷ 12 _") == [] and language.words_in("a½b x²") == ["a", "b", "x"]
    run = "".join(chr(97 + i % 26) for i in range(131))
    pieces = language.words_in(run)
    assert "".join(pieces) == run and [len(x) for x in pieces] == [48, 48, 35]


def test_words_keep_their_language(spark):
    de, en = ("der hund und die katze sind nicht hier gewesen", "the dog and a cat were never seen around there")
    model = language.train([de, en] * 30, ["de", "en"] * 30, rounds=40)
    (words, p), none = language.label_words(model, [de + " " + en, "12 ?"])
    said = [model.langs[k] for k in p.argmax(1)]
    assert len(words) == 19 and said[:8] == ["de"] * 8 and said[-9:] == ["en"] * 9 and none[0] == []


def test_streaming_viterbi_against_the_whole_lattice():
    v = sentencepieces.Vocabulary.of_model(PIECES)
    draw = random.Random(1)

    def whole(s):
        best = [(0.0, None)] + [(float("-inf"), None)] * len(s)
        for i in range(len(s)):
            one = False
            for n in range(1, min(v.longest, len(s) - i) + 1):
                found = v.pieces.get(s[i:i + n])
                if found:
                    one |= n == 1
                    if best[i][0] + found[1] > best[i + n][0]:
                        best[i + n] = best[i][0] + found[1], (i, [found[0]])
            if not one and best[i][0] + v.penalty > best[i + 1][0]:
                best[i + 1] = best[i][0] + v.penalty, (i, v.bytes_for(s[i]))
        out, i = [], len(s)
        while i:
            i, ids = best[i][1]
            out = ids + out
        return out

    for _ in range(300):
        s = "".join(draw.choice("abcdetinghe▁▁日\n") for _ in range(draw.randrange(1, 150)))
        assert [x for part in sentencepieces.stream(s, v) for x in part] == whole(s) == sentencepieces.window(s, v)


def test_pieces_round_trip(spark, odd):
    rows = sentencepieces.decode_table(sentencepieces.encode_table(odd, PIECES), PIECES).collect()
    texts = collections.Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert collections.Counter((r.doc_id, r.text) for r in rows) == texts
    assert all(r.same_text for r in sentencepieces.encode_documents(odd, PIECES).collect())


def test_licence_rules(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and more. The above copyright notice and this "
           "permission notice shall be included in all copies or substantial portions of the Software.")
    texts = [mit, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "See the License for the specific language governing permissions and "
             "limitations under the License.", "nothing here", None]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(got[i].licences, got[i].n_sentences, got[i].n_left) for i in range(5)] == [("MIT", 2, 0), ("Apache-2.0,MIT", 2, 0), ("", 1, 1), ("", 0, 0), ("", 0, 0)]


def test_page_texts(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html", F.lit("x").alias("text"))
    rows = {r.page_id: r for r in table.collect()}
    net = pages.fit(table)
    got = pages.extract(table, net).collect()
    right = 0
    for r in got:
        article = re.search("<article>(.*)</article>", rows[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        right += r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
    assert len(got) == len(rows) and right >= 0.95 * len(got)
    strange = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>a <b>b</p"), (2, "u", "<<>&amp;<script>x" + "<div>" * 3000)], "page_id long, url string, html string")
    assert len(pages.extract(strange, net).collect()) == 4
    assert pages.extract(table.limit(0)).collect() == []
    other = ('<body><div id="nav"><a href=x>Home</a></div><div class="content"><h1>Title here</h1><p>Some long main text of an article, with words &amp; many more\n words.</p>'
             '<div class="ad">Buy now cheap</div></div><div class="comments"><p>Nice article, I liked it.</p></div><footer>c</footer>')
    (one,) = pages.extract(spark.createDataFrame([(1, "u", other)], "page_id long, url string, html string"), net).collect()
    assert "Some long main text of an article, with words & many more words." in one.text and "Home" not in one.text and "Nice" not in one.text


def test_page_labels_come_from_layouts_only():
    own = '<y=foo><p data-y="x">hello</p></y=foo><div data-y="1">all</div>'
    assert [pages.container_label(path) for _, path, _ in pages.blocks(own)] == [-1, -1]
    assert [pages.container_label(path) for _, path, _ in pages.blocks('<p data-y="1">a</p><p data-y="0">b</p>', labelled=True)] == [1, 0]


def test_words_and_their_marks_have_the_same_ids():
    codec = sentencepieces.Codec(sentencepieces.Vocabulary.of_model(PIECES))
    for text in ("a single spaced text", " lead", "trail ", "two  spaces", "\n a\tb", "▁mark here", "x" * 200 + " y", "日本 語"):
        marked = sentencepieces.SPACE + text.replace(" ", sentencepieces.SPACE)
        for _ in range(2):  # the second time from what is remembered
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == [x for part in sentencepieces.stream(marked, codec.v) for x in part]


def test_lstm_gradients():
    draw = np.random.default_rng(4)
    net = pages.Labeller(hidden=3)
    x, on = pages.stack([draw.normal(size=(n, pages.DIMS)).astype(np.float32) * 0.3 for n in (4, 2)])
    y = (draw.random(on.shape) < 0.5).astype(np.float32)

    def loss():
        p = net._run(x.astype(np.float64), on)[3]
        return -(np.where(y > 0, np.log(p), np.log(1 - p)) * on).sum() / on.sum()

    for p, g in net.step(x, on, y, on.astype(np.float32)):
        k = int(np.argmax(np.abs(g)))
        flat = p.reshape(-1)
        keep, e = flat[k], 1e-2
        flat[k] = keep + e
        up = loss()
        flat[k] = keep - e
        down = loss()
        flat[k] = keep
        assert abs((up - down) / (2 * e) - g.reshape(-1)[k]) < 2e-3 + 0.05 * abs(g.reshape(-1)[k])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
