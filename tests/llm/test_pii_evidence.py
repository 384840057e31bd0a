"""PII by weak supervision: both classes have mass, planted kinds are found, look-alikes are not."""

import collections
import random
import re

import numpy as np
import pytest

from pitchlake.llm import pii
from pitchlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
#: Sentences without personal data, none of them in the decoys.
CLEAN = [
    "the treaty of 12/05/1980 was signed there", "Order 555-123-4567 has left", "Jean Valjean stole bread", "see part no. 123-45-6789 for the valve", "commit 3b18e512dba79e4c8300dd08aeb37f8e728b8dad adds tests",
    "row f81d4fae-7dec-11d0-a765-00a0c91e6bf6 is new", "installed below /usr/local/lib/python3 as usual", "MATCH_ID_2024_PERIOD_ONE_frame12 is the key", "release 2.11.0.4 of the tool", "published on 2021-03-04 in Rome",
]
WORDS = "stone river light garden paper window cloud bridge silver market winter valley".split()


def luhn_card(rng):
    digits = [4, *(rng.randrange(10) for _ in range(14))]
    return next(s for c in range(10) if pii.luhn(s := "".join(map(str, [*digits, c]))))


def planted(rng, kind):
    """(text before, the span) with a cue or a form that says what it is."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    name = lambda: rng.choice("Miller Becker Durand Lopez Carter Novak".split())
    if kind == "ssn":
        return rng.choice(["my social security number is ", "SSN: ", "insurance "]), f"{rng.randint(100, 650)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    if kind == "local_phone":
        return rng.choice(["call me, phone ", "telephone: ", "mobile "]), f"({rng.randint(201, 989)}) {rng.randint(200, 999)}-{d(4)}"
    if kind == "birth_date":
        return rng.choice(["born ", "birthday: ", "geboren am "]), f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{rng.randint(1930, 2009)}"
    if kind == "person":
        return rng.choice(["signed ", "contact ", "regards, "]), f"{rng.choice(['Mr', 'Dr', 'Frau', 'Señora'])} {rng.choice(sorted(pii.GIVEN))} {name()}"
    if kind == "address":
        return rng.choice(["lives at ", "address: ", "my address is "]), f"{rng.randint(1, 900)} {rng.choice('Oak Maple Elm Hill'.split())} {rng.choice('Street Avenue Road Lane'.split())}"
    if kind == "spelled_email":
        return rng.choice(["mail me: ", "contact ", "write to "]), f"{name().lower()}.{d(2)} (at) server{d(1)} (dot) {rng.choice(['com', 'org', 'net'])}"
    if kind == "secret":
        return rng.choice(["api_key = ", "token: ", "password="]), "".join(rng.choices("abcdef0123456789", k=40))
    if kind == "card_like":
        s = luhn_card(rng)
        return rng.choice(["credit card ", "visa: "]), ".".join(s[i : i + 4] for i in range(0, 16, 4))
    raise ValueError(kind)


def corpus(rng, kinds, n):
    """(text, {(start, end, kind)}) with filler around."""
    out = []
    for i in range(n):
        text, spans = " ".join(rng.choices(WORDS, k=8)) + " ", set()
        if i % 3 == 0:
            text += rng.choice(pii.DECOYS if i % 2 else CLEAN) + " "
        elif i % 3 == 1:
            kind = kinds[i // 3 % len(kinds)]
            before, span = planted(rng, kind)
            text += before
            spans.add((len(text), len(text) + len(span), kind))
            text += span + " "
        out.append((text + " ".join(rng.choices(WORDS, k=6)), spans))
    return out


def counted(texts):
    counts = collections.Counter()
    for t in texts:
        base = pii.base_spans(t)
        counts.update(pii.judged(t, s, e, k) for s, e, k in base)
        counts.update(c[3] for c in pii.candidates(t, base))
    return counts


FOUND = ["ssn", "local_phone", "birth_date", "person", "address", "spelled_email", "secret", "card_like"]


@pytest.fixture(scope="module")
def model():
    return pii.train(counted(t for t, _ in corpus(random.Random(1), FOUND, 1200)))


def test_precision_and_recall_by_kind_on_held_out_texts(model):
    right, found, there = (collections.Counter() for _ in range(3))
    for text, want in corpus(random.Random(2), FOUND, 1200):
        got = set(pii.spans(text, model)[1])
        found.update(k for *_, k in got - {g for g in got if g[2] in pii.BASE})
        there.update(k for *_, k in want)
        right.update(k for *_, k in got & want)
    for k in FOUND:
        assert right[k] >= 0.9 * there[k] > 10, (k, right[k], there[k])
        assert right[k] >= 0.9 * found[k], (k, right[k], found[k])


@pytest.mark.parametrize("text", CLEAN)
def test_look_alikes_are_left_alone(model, text):
    assert [s for s in pii.spans(f"once upon a time {text} and so on", model)[1] if s[2] not in pii.BASE] == []


def test_a_kind_without_evidence_is_not_accepted():
    """A corpus of secrets and cards says nothing of names and dates."""
    rng = random.Random(4)
    some = pii.train(counted(t for t, _ in corpus(rng, ["secret", "card_like"], 300)))
    assert some.evidence[pii.KINDS.index("secret")] > 10 and some.evidence[pii.KINDS.index("person")] == some.evidence[pii.KINDS.index("birth_date")] == 0
    for kind in ("person", "birth_date", "ssn", "address"):
        before, span = planted(rng, kind)
        assert pii.spans(f"{before}{span} there", some)[1] == []


def test_both_classes_have_mass_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pii.fit(docs)
    secret = pii.KINDS.index("secret")
    weak = pii.OF_A_KIND / 8
    # reliabilities have moved away from what they began with, in both classes
    assert np.abs(model.reliability[secret, :, 0] - weak[0]).max() > 0.1 and np.abs(model.reliability[secret, :, 1] - weak[1]).max() > 0.1
    assert model.evidence[secret] > 5
    for text in CLEAN:
        assert [s for s in pii.spans(text, model)[1] if s[2] not in pii.BASE] == []


def plain_spans(text, model):
    """All spans of a text, by trying every pattern on its own and settling overlaps afterwards."""
    if not text:
        return ""
    base = pii.base_spans(text)
    found = [(m.start(), m.end(), kind) for kind, p in pii.PATTERNS.items() for m in p.finditer(text)]
    found += [(m.start(), m.end(), "secret") for m in pii.SECRET.finditer(text) if re.search("[0-9]", m.group()) and pii.mixture(m.group()) > 1]
    found += [(m.start(), m.end(), "spelled_email") for m in pii.SPELLED.finditer(text)]
    found += [(m.start(), m.end(), "person") for m in pii.PERSON.finditer(text)]
    chosen = []
    for s, e, k in sorted(found, key=lambda x: (x[0], -x[1], pii.KINDS.index(x[2]))):
        over = [b for b in base if b[0] < e and s < b[1]]
        if any(c[0] < e and s < c[1] for c in chosen) or (over and k != "secret") or any(b[0] <= s and e <= b[1] for b in over):
            continue
        chosen.append((s, e, k))
    more = []
    for s, e, k in chosen:
        x = pii.features(np.array([pii.judged(text, s, e, k)]))[0]
        if model.evidence[pii.KINDS.index(k)] >= 1 and 1 / (1 + np.exp(-float(x @ model.weights))) >= pii.ACCEPT:
            more.append((s, e, k))
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(base + more, key=lambda x: (x[0], pii.KINDS.index(x[2]))))


def test_whole_spans_of_the_table_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pii.fit(docs)
    want = {r.doc_id: plain_spans(r.text, model) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.spans for r in QUERIES["op9_pii"](spark, SF).collect()} == want and sum("secret" in s for s in want.values()) > 3


def test_many_base_spans_before_a_candidate():
    text = "a1@b.cd " * 40 + "token: 0123456789abcdef0123456789abcdef01234567"
    base = pii.base_spans(text)
    assert [c[2] for c in pii.candidates(text, base)] == ["secret"]
