"""The document operators against brute-force versions, over whole small tables and odd rows."""

import collections
import hashlib
import random
import re
import struct
import unicodedata
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from test_near_dedup import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from pitchlake.llm import bpe, decontaminate, langid, pii, quality, sharding, simhash, suffix_dedup, suffixes
from pitchlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
LONG = "lorem Ipsum dolor " * 3000
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two\x0bthree"), (6, LONG), (6, LONG), (7, "x" * 30000), (8, "#### $$$ !!"), (None, "no id " * 60),
    (9, "é" * 120 + " ß Σ İ"), (10, "a b c d e f g h i j k l m n o p " * 20), (11, "A b c d e f g h i j k l m n o p " * 20), (12, "one"), (13, "123 456 !!"),
    (14, "reach me at joe.doe@mail.example.org or +1 (555) 123-4567, 10.0.0.1 and 4111 1111 1111 1111; 999.1.1.1 4111111111111112"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "src", 0, "clash", "clash") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string, spans string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- SimHash


def brute_simhash(items):
    def fp(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in items]
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(items):
        if d is not None:
            ids[find(i)].append(d)
    return sorted(((d, f"{fps[i]:016x}", min(ids[find(i)], default=None)) for i, (d, _) in enumerate(items)), key=repr)


def test_simhash(docs, odd, empty):
    assert rows(simhash.near_duplicates(docs)) == brute_simhash(pairs(docs))
    assert rows(simhash.near_duplicates(odd)) == brute_simhash(ODD)
    assert rows(simhash.near_duplicates(empty)) == []


def test_simhash_links_are_all_found_once(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds.tolist():
        for n in range(7):
            x = s
            for b in rng.choice(64, n, replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(simhash.signed(x) for x in fps)
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_one_of_each(odd):
    kept = [r.doc_id for r in simhash.one_of_each(odd).collect()]
    want = set(brute_components([(d, t) for d, t in ODD if d is not None]).values())
    assert sorted(x for x in kept if x is not None) == sorted(want) and kept.count(None) == 1


# -- decontamination


def brute_contamination(items, bench):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = collections.defaultdict(set)
    for i, t in bench:
        w = words(t)
        n = min(10, len(w))
        if n and i is not None:
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for d, t in items:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_with_a_full_bitmap(spark, monkeypatch, docs):
    """A bitmap of 64 bits lets nearly everything through: the join alone decides."""
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 6)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert rows(decontaminate.report(decontaminate.contamination(docs, bench))) == brute_contamination(pairs(docs), items)


def test_decontamination(spark, docs, odd, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = brute_contamination(pairs(docs), items)
    assert any(r[-1] for r in want)
    assert rows(decontaminate.report(decontaminate.contamination(docs, bench))) == want
    clean = {d for d, *_, hit in want if not hit}
    assert {r.doc_id for r in decontaminate.uncontaminated(docs, bench).collect()} == clean
    short = [(1, "one"), (2, "B c d e"), (3, None), (4, "!!"), (None, "one"), (1, "k l m n o p a b c d e"), (10, "lorem ipsum dolor lorem ipsum dolor lorem ipsum dolor lorem")]
    other = spark.createDataFrame(short, "item_id long, text string")
    want = brute_contamination(ODD, short)
    assert rows(decontaminate.report(decontaminate.contamination(odd, other))) == want
    assert rows(decontaminate.contamination(empty, other)) == []
    assert all(not r.contaminated for r in decontaminate.report(decontaminate.contamination(odd, other.filter("false"))).collect())


# -- suffix dedup


def brute_suffix(items, window=100):
    """Rows of a smaller doc_id are earlier; rows that share one take nothing from each other."""
    out, seen = [], set()
    by_id = collections.defaultdict(list)
    for d, t in items:
        by_id[d].append((t or "").encode())
    for d in sorted(by_id, key=lambda x: (x is None, x)):
        new = set()
        for b in by_id[d]:
            gone, own = np.zeros(len(b), dtype=bool), set()
            for i in range(len(b) - window + 1):
                w = b[i : i + window]
                if d is not None and (w in seen or w in own):
                    gone[i : i + window] = True
                own.add(w)
            new |= own
            spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
            out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
        seen |= new
    return sorted(out, key=repr)


def test_suffix_dedup_with_ids_that_clash(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    a, b, c = word(400), word(300), word(250)
    items = [(1, a), (1, "short"), (2, a[50:350] + b), (1, c + a[:200]), (1, a), (3, b + b + c), (3, b), (3, None), (2, a[50:350] + b), (None, a), (4, "x" * 500), (4, "x" * 90 + "y" + "x" * 120)]
    for hot in (1000, 2):
        assert rows(suffix_dedup.remove(suffix_dedup.repeats(spark.createDataFrame(items, "doc_id long, text string").repartition(3), hot=hot))) == brute_suffix(items)


def test_suffix_dedup_of_a_passage_that_all_share(spark):
    """Copies collapse in parts, and pieces that differ around a shared phrase are cut finer; hot groups of both kinds."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage, phrase = word(260), word(108)
    items = [(i, word(rng.randint(0, 150)) + (passage if i % 2 else phrase) + word(rng.randint(0, 150))) for i in range(160)]
    for hot in (1000, 10):
        got = suffix_dedup.remove(suffix_dedup.repeats(spark.createDataFrame(items, "doc_id long, text string").repartition(5), hot=hot))
        assert rows(got) == brute_suffix(items)


@pytest.mark.parametrize("hot", [1000, 2])
def test_suffix_dedup(docs, odd, empty, hot):
    want = brute_suffix(pairs(docs))
    assert sum(r[2] for r in want)
    assert rows(suffix_dedup.remove(suffix_dedup.repeats(docs, hot=hot))) == want
    assert rows(suffix_dedup.remove(suffix_dedup.repeats(odd, hot=hot))) == brute_suffix(ODD)
    assert rows(suffix_dedup.remove(suffix_dedup.repeats(empty, hot=hot))) == []


def test_suffix_dedup_in_segments(monkeypatch, docs):
    monkeypatch.setattr(suffixes, "SEGMENT", 150)
    raws = [(t or "").encode() for _, t in pairs(docs)][:20]
    text, start, count, *_ = suffixes.runs(raws)
    places = sorted((t, s + j) for t, s, c in zip(text.tolist(), start.tolist(), count.tolist()) for j in range(c))
    assert places == [(i, s) for i, r in enumerate(raws) for s in range(len(r) - 99)]


def test_deep_shallow_sort():
    rng = np.random.default_rng(2)
    pool = [bytes(rng.integers(0, 2, n, dtype=np.uint8)) for n in range(90)] + [b"q" * n for n in range(60)]
    strings = [pool[i] + pool[j] for i, j in rng.integers(0, len(pool), (400, 2))]
    group = rng.integers(0, 3, 400)
    order, lcp = suffixes.deep_shallow_sort(strings, group)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings))
    for a, b, n in zip(order, order[1:], lcp[1:].tolist()):
        assert n == (suffixes.common_prefix(strings[a], strings[b]) if group[a] == group[b] else 0)


# -- quality rules


def duck(sf, sql):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c.execute(sql)


def test_quality_matches_sql(spark):
    got = QUERIES["op6_quality_rules"](spark, SF)
    found = duck(SF, ORACLE_SQL["op6_quality_rules"])
    names = [d[0] for d in found.description]
    assert rows(got.select(names)) == sorted(found.fetchall(), key=repr)


def test_decontamination_matches_sql(spark):
    got = QUERIES["op4_decontamination"](spark, SF)
    found = duck(SF, ORACLE_SQL["op4_decontamination"])
    names = [d[0] for d in found.description]
    assert rows(got.select(names)) == sorted(found.fetchall(), key=repr)


def test_quality_odd_rows(odd, empty):
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) for r in quality.judge(odd).collect() if r.doc_id is not None)
    want = []
    for d, t in ODD:
        if d is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            n = collections.Counter(zip(w, w[1:], w[2:]))
            hit = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if n[g] > 1 for j in range(3)}
            want.append((d, len(w), sum(map(len, w)), len(hit), 0))
    assert got == sorted(want)
    assert rows(quality.judge(empty)) == []
    assert all(not r.kept for r in quality.judge(odd).collect() if r.n_words < 50)


# -- sharding


def test_sharding(docs, odd, empty):
    for df, items in ((docs, pairs(docs)), (odd, ODD)):
        got = sharding.assign(df, 24).collect()
        assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in items), key=repr)
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert set(by) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
        counts = [len(by.get(s, ())) for s in range(24)]
        assert max(counts) - min(counts) <= 1
    assert rows(sharding.assign(docs)) == rows(sharding.assign(docs)) != rows(sharding.assign(docs, seed=7))
    assert rows(sharding.assign(empty)) == []


def test_sharding_does_not_depend_on_the_cluster(spark, docs, odd):
    """Same places whatever the number of shuffle partitions and the split of the input, also over many buckets."""
    first = [rows(sharding.assign(df, 24, bucket_bytes=20_000)) for df in (docs, odd)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert [rows(sharding.assign(df.repartition(7), 24, bucket_bytes=20_000)) for df in (docs, odd)] == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sharding_spreads_equal_rows(spark):
    df = spark.range(1).selectExpr("cast(5 as long) as doc_id", "'same' as text").crossJoin(spark.range(400).select()).repartition(3)
    got = sharding.assign(df, 4, bucket_bytes=100).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(4) for i in range(100)]


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "shards"), 5)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert rows(back.select(docs.columns)) == rows(docs) and back.select("shard").distinct().count() == 5
    clash = docs.selectExpr("*", "'a' as shard", "'b' as slot", "'c' as size", "'d' as text_crc32", "'e' as row", "1.5 as bucket")
    sharding.write_shards(clash, str(tmp_path / "clash"), 5)
    back = spark.read.parquet(str(tmp_path / "clash"))
    assert rows(back.select([f"{c}_input" if c == "shard" else c for c in clash.columns])) == rows(clash)
    sharding.write_shards(docs.filter("false"), str(tmp_path / "none"), 5)


# -- BPE


def test_bpe(docs, odd, empty):
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    items = pairs(docs) + ODD + [(20, "<|startoftext|>Hi<|endoftext|> <|no|>"), (21, "漢字 Ω σς Ǆ é   x")]
    model = bpe.load(bpe.vocabulary_path())
    for _, t in items:
        want = lib.encode(t or "", add_special_tokens=False).ids
        ids = model.encode(t or "")
        assert ids.tolist() == want and model.decode(ids) == lib.decode(want, skip_special_tokens=False)
    got = bpe.encode_documents(odd, outputs=("n_tokens", "ids", "ids_sha256")).collect()
    for r, (d, t) in zip(sorted(got, key=lambda r: repr(r.doc_id)), sorted(ODD, key=lambda x: repr(x[0]))):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids) == (d, len(want), want)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
    assert rows(bpe.encode_documents(empty)) == []


def test_bpe_normalises_and_splits_every_character_like_the_library():
    """Each character between letters, at a word's end and between digits; those that Python's tables do not have go by the library."""
    lib, model = Tokenizer.from_file(bpe.vocabulary_path()), bpe.load(bpe.vocabulary_path())
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn" and not 0xAC10 < c < 0xD7A0 and not 0x4E10 < c < 0x9F00 and not 0x20010 < c < 0x32000 and c < 0xE0200]
    codes += [0x558, 0x88F, 0x1C89, 0x10D50, 0x323B0]
    for i in range(0, len(codes), 500):
        text = " ".join(f"ab{chr(c)}cd 1{chr(c)}2 e{chr(c)} 'S{chr(c)}" for c in codes[i : i + 500])
        assert model.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids, hex(codes[i])


def test_bpe_merges_words_alike_alone_and_together():
    model = bpe.load(bpe.vocabulary_path())
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghinorst" if rng.random() < 0.7 else "aab", k=rng.randint(2, 64))) for _ in range(3000)] + ["aa", "aaa", "a" * 64, "thethethe", "abab" * 16]
    symbols = [model.symbols(w) for w in words]
    together = bpe.merged_together([list(x) for x in symbols], model)
    assert [x.tolist() for x in together] == [bpe.merged(list(x), model.rank_of, model.made) for x in symbols]


# -- PII


def brute_base(t):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.BASE.index(x[1])))


def test_pii_base_spans(docs):
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("a.@+1290 -()4b"), 40)) for _ in range(4000)]
    for t in [t or "" for _, t in pairs(docs) + ODD] + made:
        assert [(s, k, e) for s, e, k in pii.base_spans(t)] == brute_base(t), t


def test_pii_query_and_mask(spark, odd, empty):
    model = pii.fit(odd)
    got = {r.doc_id: r for r in pii.report(pii.find(odd, model)).collect()}
    assert (got[14].n_email, got[14].n_ip, got[14].n_card, got[14].n_phone) == (1, 1, 1, 1)
    want = ",".join(f"{k}:{s}:{e}" for s, k, e in brute_base(ODD[-1][1]))
    assert got[14].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= set(got[14].spans.split(","))
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r for r in pii.mask(odd, model).collect()}
    assert "joe.doe" not in masked[14].text and "[EMAIL]" in masked[14].text and masked[1].text is None and masked[4].words == "clash"
    assert rows(pii.find(empty, pii.fit(empty))) == []


def test_pii_model_adds_spans(spark):
    good = [f"Dear sir, my name is Mary {x} and my phone is (555) 234-56{i:02d}. My ssn 123-45-67{i:02d}." for i, x in enumerate(["Smith", "Jones", "Brown", "Clark"] * 10)]
    bad = [f"See version 1{i}.2 of the section 123-45-00{i:02d}." for i in range(10)]
    model = pii.fit(spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string"))
    kinds = {k for _, _, k in pii.spans(good[0], model)[1]}
    assert {"person", "local_phone", "ssn"} <= kinds
    assert not pii.spans("We saw The Old Man in version 2.0 of 2020-13-45", model)[1]


def test_pii_finds_secrets_and_leaves_plain_text(spark):
    """Planted secrets and loose forms among clean texts; a clean text gets no span."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + ". "
    secret = [lambda: f'token = "{rng.getrandbits(160):040x}"', lambda: f"api_key: sk-{''.join(rng.choices('abcdefghijkABCDEFGHIJK0123456789', k=32))}", lambda: f"password={''.join(rng.choices('abcdefghijkABCDEFGHIJK0123456789', k=20))}"]
    plain = [lambda: "Licensed under the Apache License, Version 2.0. ", lambda: f"see section {rng.randint(1, 9)}.{rng.randint(1, 9)} of release 10.4 ", lambda: f"{rng.randint(1000, 9999)} https://example.org/a/{word()}/{word()} ", lambda: f"{word()}_{word()}_{word()}2 "]
    dirty = [prose(30) + secret[i % 3]() + " " + prose(20) for i in range(60)]
    clean = [prose(30) + plain[i % 4]() + prose(20) for i in range(240)]
    model = pii.fit(spark.createDataFrame(list(enumerate(dirty + clean)), "doc_id long, text string").repartition(4))
    assert np.mean([any(k == "secret" for *_, k in pii.spans(t, model)[1]) for t in dirty]) >= 0.9
    assert np.mean([not pii.spans(t, model)[1] for t in clean]) >= 0.95


def test_pii_query_adds_secrets_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in pii.report(pii.find(docs, pii.fit(docs))).collect()}
    has = {d for d, t in pairs(docs) if t and re.search(r'token = "[0-9a-f]{40}"', t)}
    assert has and all(got[d].n_secret for d in has)
    base = {d for d, t in pairs(docs) if t and pii.base_spans(t)}
    assert not {d for d, r in got.items() if r.n_spans} - has - base - {d for d, t in pairs(docs) if t and "TOKEN" in t}


def test_expectation_maximisation_against_a_plain_version():
    """Row by row with probabilities, not in counts and logarithms."""
    rng = np.random.default_rng(1)
    truth = rng.random(300) < 0.4
    votes = np.where(rng.random((300, 4)) < [0.9, 0.8, 0.7, 0.6], np.where(truth[:, None], 1, -1), rng.integers(-1, 2, (300, 4)))
    kinds, n = np.unique(votes, axis=0, return_counts=True)
    got, rel = pii.expectation_maximisation(kinds, n.astype(float), rounds=7)
    post = [1 / (1 + np.exp(-1.5 * sum(v) + 0.5)) for v in votes]
    for _ in range(7):
        table = [[[4.0, 4.0, 2.0], [0.5, 4.0, 5.5]] for _ in range(4)]
        for v, p in zip(votes, post, strict=True):
            for j in range(4):
                table[j][1][v[j] + 1] += p
                table[j][0][v[j] + 1] += 1 - p
        table = [[[x / sum(row) for x in row] for row in t] for t in table]
        prior, new = (1 + sum(post)) / (2 + len(votes)), []
        for v in votes:
            yes, no = prior, 1 - prior
            for j in range(4):
                yes, no = yes * table[j][1][v[j] + 1], no * table[j][0][v[j] + 1]
            new.append(yes / (yes + no))
        post = new
    want = {tuple(v): p for v, p in zip(votes.tolist(), post, strict=True)}
    assert got == pytest.approx([want[tuple(v)] for v in kinds.tolist()], abs=1e-9)
    assert rel == pytest.approx(np.array(table), abs=1e-9)
    assert np.mean((np.array(post) > 0.5) == truth) > 0.9


# -- language ID


def test_langid(spark, docs, odd, empty):
    got = langid.identify(docs).collect()
    langs = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert held and np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.97
    model = langid.fit(docs)
    out = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3, 13)] == ["und"] * 4 and out[1].score == 0 and out[6].lang_pred in model.langs
    assert {r.doc_id for r in langid.recognised(odd, model).collect()} == {d for d, t in ODD if t and any(map(str.isalpha, t))}
    assert set(langid.classify(["²½ 12", "٣_", "é"], model)[0][:2]) == {"und"}  # digits and fractions are no letters
    assert rows(langid.identify(empty)) == []


def test_langid_code_lengths_are_exact(docs):
    """Against a plain implementation that walks the contexts byte by byte."""
    items = [(t or "").encode() for _, t in pairs(docs)]
    model = langid.build([langid.grams(items[:30]), langid.grams(items[30:60])], ["a", "b"], [1, 1])
    trees = []
    for part in (items[:30], items[30:60]):
        tree = collections.defaultdict(collections.Counter)
        for raw in part:
            raw = b"\n" * 3 + raw
            for i in range(3, len(raw)):
                for k in range(4):
                    tree[raw[i - k : i]][raw[i]] += 1
        trees.append(tree)
    for raw in items[60:70] + ["ø unseen ж".encode(), b""]:
        for x, tree in enumerate(trees):
            bits, padded = 0.0, b"\n" * 3 + raw
            for i in range(3, len(padded)):
                for k in (3, 2, 1, 0, -1):
                    after = tree.get(padded[i - k : i]) if k >= 0 else None
                    if k < 0:
                        bits += 8
                    elif after:
                        n, q = sum(after.values()), len(after)
                        if padded[i] in after:
                            bits -= np.log2(after[padded[i]] / (n + q))
                            break
                        bits -= np.log2(q / (n + q))
            assert langid.code_lengths([raw], model)[0, x] == pytest.approx(bits, rel=1e-5, abs=1e-6)


# -- the pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    items = [(d, t) for d, t in pairs(docs) if t and re.search(r"[^\W\d_]", t)]
    kept = set(brute_components(items).values())
    items = [(d, t) for d, t in items if d in kept]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, *_, hit in brute_contamination(items, bench) if hit}
    items = [(d, t) for d, t in items if d not in dirty]
    assert set(got) == {d for d, _ in items}
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    model = pii.fit(spark.createDataFrame(items, "doc_id long, text string"))
    for d, t in items:
        assert got[d].ids == lib.encode(pii.masked(t, pii.spans(t, model)[1]), add_special_tokens=False).ids


def test_stages_keep_columns_and_odd_rows(spark, odd):
    docs = odd.selectExpr("*", "1 as root", "2 as fp", "3 as node", "'a' as component_id", "'b' as digest", "'c' as raw", "4 as n_words")  # names that stages use inside
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.filter("false"), SF).count() == 0
        docs = out
    assert {r.doc_id for r in docs.collect()} >= {5, 6, 7, 14}
