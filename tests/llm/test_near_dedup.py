"""The pipeline's near-dedup stage against exact similarity of all pairs."""

import collections
import random

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def brute_components(items):
    """The smallest doc_id of each document's group: links at a Jaccard similarity of 0.8 on five-word shingles."""
    sets = []
    for _, t in items:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(x & y)
            if x == y or 5 * both >= 4 * (len(x) + len(y) - both) > 0:
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(items):
        ids[find(i)].append(d)
    return {d: min(ids[find(i)]) for i, (d, _) in enumerate(items)}


def made():
    """Groups of a text and copies with single words replaced: similarities from about 0.6 to 0.98, and chains of them."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    items = []
    for n in (30, 60, 150, 250) * 15:
        text = [word() for _ in range(n)]
        items.append(" ".join(text))
        for k in range(1, 7):
            copy = text if k % 2 else list(items[-1].split())
            copy = list(copy)
            for at in rng.sample(range(n), max(1, n * (k % 4 + 1) // 120)):
                copy[at] = word()
            items.append(" ".join(copy))
    rng.shuffle(items)
    return list(enumerate(items)) + [(9001, "one"), (9002, "One"), (9003, None), (9004, " ")]


def test_stage_drops_near_copies_at_similarity_0_8(spark):
    items = made()
    want = brute_components(items)
    assert len(set(want.values())) < 0.5 * len(items)
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(items, "doc_id long, text string"), SF)
    assert {r.doc_id for r in got.collect()} == set(want.values())


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_large_groups_lose_no_pair(spark, monkeypatch):
    """With groups of 8 rows all three ways are taken: by half, by variant, and variants in parts."""
    from pitchlake.llm import simhash

    monkeypatch.setattr(simhash, "GROUP_ROWS", 8)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    items = made()[:200]
    # two families of near copies that are no near copies of each other, but whose fingerprints share most halves
    base = [word() for _ in range(400)]
    other = base[:340] + [word() for _ in range(60)]
    for family, n in ((base, 30), (other, 60)):
        for _ in range(n):
            copy = list(family)
            copy[rng.randrange(400)] = word()
            items.append((5000 + len(items), " ".join(copy)))
    want = brute_components(items)
    got = simhash.similar(spark.createDataFrame(items, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_parts_of_a_group_give_the_pairs_of_the_whole(spark, monkeypatch):
    """What is proposed between components is the same, however small the groups."""
    from pyspark.sql import functions as F

    from pitchlake.llm import simhash

    docs = spark.createDataFrame(made()[:150], "doc_id long, text string")
    nodes = simhash.stored(simhash.sketches(docs).select("node", (F.col("doc_id") % 7).alias("root"), (F.col("doc_id") % 7 + 1).alias("size"), *simhash.FP).filter("node != 0"))
    whole = {tuple(r) for r in simhash.proposed(nodes, star=False).collect()}
    for rows in (40, 5, 2):
        monkeypatch.setattr(simhash, "GROUP_ROWS", rows)
        assert {tuple(r) for r in simhash.proposed(nodes, star=False).collect()} == whole and len(whole) > 40


def test_rows_of_a_repeated_id_are_judged_by_their_own_texts(spark):
    a, x, y = ("alpha beta gamma delta epsilon zeta " * 9, "one two three four five six seven " * 8, "eins zwei drei vier fuenf sechs sieben")
    rows = [(3, a, 1, 1, 1), (5, a, 1, 1, 1), (5, x, 1, 1, 1), (5, x, 2, 2, 2), (6, y, 1, 1, 1), (6, y + " acht", 1, 1, 1), (None, a, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept int, _place int, kept_id int")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text) for r in got.collect())) == sorted([(0, a), (3, a), (5, x), (6, y), (6, y + " acht")])


def test_decontamination_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "d", "e")], "doc_id long, text string, _digest string, dirty string")
    assert corpus_pipeline.drop_contaminated(spark, docs, SF).collect() == docs.collect()


def test_variants_of_stored_fingerprints_are_not_broadcast(spark):
    """They are 66 rows a fingerprint, which estimates by the stored file's size do not see: a broadcast took the driver's memory."""
    from pyspark.sql import functions as F

    from pitchlake.llm import simhash

    fps = simhash.stored(spark.range(3000).select(F.xxhash64("id").alias("fp")))
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan


def test_a_star_tells_each_link_of_a_large_group_once():
    """Near copies share nearly all halves: a link under each of them is 38 times the rows. Every copy keeps a link."""
    import numpy as np

    from pitchlake.llm import simhash

    rng = np.random.default_rng(4)
    n = 400
    bits = np.tile(rng.integers(0, 2, 64 * simhash.WIDE_WORDS), (n, 1))
    for row in bits:
        row[rng.choice(bits.shape[1], 6, replace=False)] ^= 1
    fps = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8")
    rows = np.column_stack([np.arange(n), np.arange(n), np.ones(n, dtype=np.int64), fps.view(np.int64)])
    told = []
    for half, (at, m, _, _) in enumerate(simhash.HALVES):
        key = simhash.segment_bits(fps, at, m)
        told += [p for k in np.unique(key) for p in simhash.near_pairs(half, rows[key == k], star=True)]
    told = np.concatenate(told, axis=1)
    assert set(told.ravel().tolist()) == set(range(n)) and n - 1 <= told.shape[1] < 8 * n, told.shape


def test_a_row_near_a_large_component_tells_its_nearest_there(spark):
    """Rows that are near a component of n but not of it told n pairs each, a number that grew with the square of the family."""
    import numpy as np

    from pitchlake.llm import simhash

    rng = np.random.default_rng(6)
    n, outside = 300, 40
    bits = np.tile(rng.integers(0, 2, 64 * simhash.WIDE_WORDS), (n, 1))
    for i, row in enumerate(bits):
        row[rng.choice(bits.shape[1], 6 if i >= outside else 12, replace=False)] ^= 1
    fps = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8").view(np.int64)
    root = [i if i < outside else outside for i in range(n)]
    size = [1 if i < outside else n - outside for i in range(n)]
    nodes = simhash.stored(spark.createDataFrame([(i, root[i], size[i], *fps[i].tolist()) for i in range(n)], simhash.NODE_SCHEMA))
    every = {tuple(r) for r in simhash.proposed(nodes, star=False).collect()}
    told = [tuple(r) for r in simhash.proposed(nodes, star=False, nearest=True).collect()]
    family = lambda pairs: {p for p in pairs if p[1] >= outside > p[0]}
    assert len(family(every)) > 0.8 * outside * (n - outside)
    assert {(a, b) for a, b, _ in told} <= every and len({p[:2] for p in family(told)}) < 0.1 * len(family(every))
    # no row that has pairs with a component is left without one, and where not all are told, it is said
    assert {(a, root[b]) for a, b in every} == {(a, root[b]) for a, b, _ in told}
    silent = {(a, root[b]) for a, b in every - {p[:2] for p in told}}
    assert silent <= {(a, root[b]) for a, b, more in told if more}
