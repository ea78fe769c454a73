"""The pipeline's near-duplicate stage against brute force over planted edited copies."""

import random
import time

from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import common, near_copies, simhash


def test_stage_finds_edited_copies(spark):
    draw = random.Random(5)
    texts = []
    for i in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randrange(60, 400))]
        texts.append(words)
        for _ in range(4):  # every edit breaks five shingles
            copy = list(words)
            for at in draw.sample(range(len(copy)), max(1, len(copy) * draw.choice([1, 2, 3]) // 100)):
                copy[at] = f"x{draw.randrange(10 ** 6)}"
            texts.append(copy)
    centre = [f"c{k}" for k in range(300)]
    for i in range(300):  # copies of a short text, each with an edit of its own: hardly two are similar enough
        texts.append([w if k != i % 28 else f"z{i}" for k, w in enumerate(centre[:30])])
    for i in range(400):  # one large group
        texts.append([w if k not in (i % 290, (i * 7) % 290) else f"y{i}" for k, w in enumerate(centre)])
    rows = [(i, " ".join(words), i % 3) for i, words in enumerate(texts)] + [(5000, None, 0), (5001, "", 0), (None, "", 0), (5002, "one two", 0), (5003, "One  TWO", 0)]
    sets = [(i, near_copies.shingles(t)) for i, t, _ in rows if i is not None]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if near_copies.similarity(a, b) >= 0.8:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = corpus_pipeline.STAGES[2][1](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({top(i) for i in root})


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n int, root string")
    assert near_copies.one_of_each(docs).collect() == []


def test_the_exact_filter_loses_no_pair(spark):
    draw = random.Random(7)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for i in range(150):
        a, n = draw.randrange(200), draw.randrange(4, 90)
        words = base[a // 20 * 20:][:n]
        for _ in range(draw.randrange(4)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(50)}"
        texts.append(" ".join(words))
    sets = {i: near_copies.shingles(t) for i, t in enumerate(texts)}
    apart = spark.createDataFrame([(i, len(s), i) for i, s in sets.items()], "set long, n int, root long")
    table = spark.createDataFrame(list(enumerate(texts)), "set long, text string")
    for least in (0.8, 0.5):
        got = {(r.a, r.b) for r in near_copies.likely(near_copies.rare_first(apart, table, 5), least).collect()}
        want = {(i, j) for i in sets for j in sets if i < j and near_copies.similarity(sets[i], sets[j]) >= least}
        assert want <= got and len(got) < 5 * len(want) + 50


def test_the_stage_goes_by_simhash(spark, monkeypatch):
    """Fingerprints within two bits are found by op5's search, and alone give the groups of texts that share no bucket."""
    draw = random.Random(11)
    words = [[f"w{draw.randrange(9000)}" for _ in range(600)] for _ in range(20)]
    texts = [" ".join(w) for w in words] + [" ".join([*w, "end"]) for w in words] + [None, "", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: near_copies.shingles(t) for i, t in enumerate(texts)}
    fps = {i: simhash.majority(s) for i, s in sets.items()}
    names = {near_copies.name(s): i for i, s in sorted(sets.items(), reverse=True)}
    known = near_copies.sketches(docs.withColumn("mark", docs.doc_id), 5, 4, 4).select("set", "n", "fp").distinct()
    got = {tuple(sorted((names[r.a], names[r.b]))) for r in near_copies.close(known, 0.8).collect()}
    want = {(i, j) for i in fps for j in fps if names[near_copies.name(sets[i])] == i < j == names[near_copies.name(sets[j])]
            and (fps[i] ^ fps[j]).bit_count() <= 2 and 0.8 <= len(sets[i]) / len(sets[j]) <= 1.25}
    assert got == want and len(want) >= 15

    linked = {j for i, j in want if near_copies.similarity(sets[i], sets[j]) >= 0.8}
    sketched = near_copies.sketches

    def without_buckets(*args):
        return sketched(*args).withColumn("bands", F.array(F.col("set")))
    monkeypatch.setattr(near_copies, "sketches", without_buckets)
    left = {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, "").collect()}
    assert left == set(names.values()) - linked


def test_texts_short_of_the_similarity_make_few_pairs(spark):
    """A large group of texts that share most shingles, few of them 0.8 similar, with words that each goes with some of the others:
    the filter makes those pairs, and not the many that differ in a few shingles more."""
    draw = random.Random(3)
    texts = []
    for _ in range(200):
        words = [f"c{k}" for k in range(150)]
        for at in range(4, 150, 24):
            words[at] = f"v{draw.randrange(6)}"
        texts.append(words)
    texts += [[*words, "more"] for words in texts[:20]]
    sets = {i: near_copies.shingles(" ".join(w)) for i, w in enumerate(texts)}
    want = {(i, j) for i in sets for j in sets if i < j and near_copies.similarity(sets[i], sets[j]) >= 0.8}
    apart = spark.createDataFrame([(i, len(s), i) for i, s in sets.items()], "set long, n int, root long")
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "set long, text string")
    places = near_copies.rare_first(apart, table, 5)
    got = {(r.a, r.b) for r in near_copies.likely(places, 0.8).collect()}
    assert {(i, 200 + i) for i in range(20)} <= want <= got and len(got) < 3 * len(want)


def shuffle_files(spark, most, seconds=20):
    """How many shuffle files there are now, or once they are no more than most: they go soon after a query's end, not with it."""
    until = time.time() + seconds
    while True:
        now = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("/shuffle_")
        if now <= most or time.time() > until:
            return now
        time.sleep(0.5)


def test_a_cut_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark, -1, 0), spark.conf.get(common.DROP_SHUFFLES, None)
    for _ in range(20):
        rows = common.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(7).withColumnRenamed("id", "k"), "k"))
    assert sorted(r["count"] for r in rows.collect()) == [142] * 1 + [143] * 6
    assert sum(r["count"] for r in rows.collect()) == 1000
    assert shuffle_files(spark, before) <= before
    assert spark.conf.get(common.DROP_SHUFFLES, None) == setting


def test_the_shuffles_of_the_stage_do_not_add_up(spark):
    """The stage has some hundred shuffles; those whose rows were kept elsewhere go before the next ones come."""
    draw = random.Random(13)
    words = [[f"w{draw.randrange(3000)}" for _ in range(80)] for _ in range(60)]
    words += [[*w[:k], f"x{k}", *w[k + 1:]] for w in words[:30] for k in (9, 70)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    before = shuffle_files(spark, -1, 0)
    got = corpus_pipeline.STAGES[2][1](spark, docs, "")
    assert shuffle_files(spark, before + 60) <= before + 60
    sets = [near_copies.shingles(" ".join(w)) for w in words]
    assert {r.doc_id for r in got.collect()} == {j for j, b in enumerate(sets) if all(near_copies.similarity(a, b) < 0.8 for a in sets[:j])}


def test_components_of_chains_and_stars(spark):
    draw = random.Random(17)
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(i, 300) for i in range(301, 330)] + [(7, 7), (330, 7), (7, 330)]
    edges += [(draw.randrange(400, 520), draw.randrange(400, 520)) for _ in range(70)]
    root = {x: x for e in edges for x in e}

    def top(x):
        return x if root[x] == x else top(root[x])
    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = [(r.node, r.root) for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted((x, top(x)) for x in linked)
