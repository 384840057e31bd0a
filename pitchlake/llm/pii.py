"""Personal data and secrets by weak supervision.

Fixed patterns give the base spans, which always stay. Looser patterns propose
further candidates. Regex, gazetteer and context labelers vote on every
candidate, those of the base kinds included (for, against, abstain).
Expectation-maximisation estimates each labeler's reliability for each kind, as a
labeler means something else in each, from how they agree over the whole corpus and
on a list of decoys: look-alikes that are known not to be personal data, and weigh as much as the
kind's candidates do. With it goes the probability that a candidate is personal
data, by its votes. A logistic classifier of spans is trained on these
probabilities as soft labels; it sees a span's shape and surroundings besides the
votes. A second pass over the texts keeps the candidates that it accepts, of kinds for
which the corpus has evidence: without candidates that are likely by their votes, nothing of a kind is added.

What is counted over the corpus is a table of (kind, votes, shape): as many rows
as there are such combinations at most, however many documents.

Defined results: a null or empty text has no spans; very long texts are read
whole; of candidates that overlap, the leftmost stays, then the longest, then the
first kind in KINDS; a candidate that touches a base span is left out, but for a
secret; without candidates nothing is added; repeated rows each get a row and
count each; other columns are ignored (mask() keeps them); an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.common import map_batches

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn", "local_phone", "spelled_email", "person", "birth_date", "address", "secret", "ipv6", "card_like")
KINDS = BASE + EXTRA
ACCEPT = 0.8

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is tried from its start only: a later start in it fails where the first does.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Cue words, titles, given names and street words of the gazetteers.
CUES = {
    "iban": "iban account konto kontonummer compte cuenta bank banque banco".split(),
    "ssn": "ssn social security insurance sozialversicherung sécurité sociale seguridad social".split(),
    "local_phone": "phone tel telephone telefon téléphone teléfono mobile handy portable móvil cell fax call ruf appelez llame".split(),
    "spelled_email": "email mail e-mail correo courriel contact kontakt contacto write".split(),
    "person": "name named called contact signed regards sincerely from dear by author heißt nom nommé nombre llamado".split(),
    "birth_date": "born birth birthday dob geboren geburtsdatum né née naissance nacido nacida nacimiento".split(),
    "secret": "token key apikey secret password passwd pwd passwort bearer authorization credential credentials auth private".split(),
    "ipv6": "ip ipv6 address host server adresse addr".split(),
    "card_like": "card credit visa mastercard karte kreditkarte carte tarjeta".split(),
    "email": "email mail e-mail correo courriel contact kontakt contacto write".split(),
    "ip": "ip ipv4 address host server adresse addr login".split(),
    "card": "card credit visa mastercard karte kreditkarte carte tarjeta".split(),
    "phone": "phone tel telephone telefon téléphone teléfono mobile handy portable móvil cell fax call ruf appelez llame".split(),
    "address": "address live lives lived resident adresse wohnt wohnhaft habite domicilio vive dirección".split(),
}
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Monsieur Madame Sr Sra Señor Señora".split()
GIVEN = set(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Peter Hans Klaus Ursula Sabine Jürgen Wolfgang Petra Stefan Monika Jean Pierre Marie Michel Nathalie François Sophie Luc Isabelle Camille "
    "José Juan Carmen María Antonio Ana Luis Pedro Pilar Javier Emma Olivia Noah Anna Maria Paul Daniel Laura Julia Lucas".split()
)
STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Way|Place|Square"
MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
PATTERNS = {
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ipv6": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card_like": re.compile(r"(?<![0-9.-])[0-9]{4}(?:[ .-][0-9]{4}){3}(?![0-9.-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "local_phone": re.compile(r"(?<![0-9+.\w-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])"),
    "birth_date": re.compile(rf"(?<![0-9/.-])(?:[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-](?:19|20)[0-9]{{2}}|(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|(?:{MONTH}) [0-9]{{1,2}},? (?:19|20)[0-9]{{2}})(?![0-9/-])"),
    "address": re.compile(rf"(?<![0-9.])[0-9]{{1,5}} (?:[A-Z][a-z]+ ){{1,3}}(?:{STREET})\b"),
}
SPELLED = re.compile(r"\b[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63})+", re.IGNORECASE)
PERSON = re.compile(rf"\b(?:(?:{'|'.join(TITLES)})\.? (?:[A-Z]\w+)(?: [A-Z]\w+)?|(?:{'|'.join(sorted(GIVEN))}) [A-Z]\w+)\b")
#: Long runs of the characters that keys and tokens are written with, digits among them; what is a secret is for the labelers to say.
SECRET = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9]))?")
#: How keys of common services begin, and letters of a hash or key in hexadecimal.
SECRET_PREFIX = ("AKIA", "ASIA", "sk-", "sk_", "pk_", "rk_", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "AIza", "eyJ", "ya29")
HEX = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
#: What comes right before a name.
INTRODUCED = re.compile(r"(?:name is|named|called|signed|dear|regards,?|contact|heißt?|heiße|nommée?|appelle|llamo|llama)[ \n]$", re.IGNORECASE)
#: Whole tokens of some of these services.
TOKEN_FORMS = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pos]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|AIza[A-Za-z0-9_-]{35}|[sprk]k[_-](?:live|test|proj)?[_-]?[A-Za-z0-9]{20,}|xox[bp]-[A-Za-z0-9-]{20,}")
ASSIGNED = re.compile(r"[=:]\s*[\"']?$")
NOT_PERSONAL = re.compile(
    r"version|licen[sc]e|copyright|isbn|\brfc|chapter|figure|section|\bpage|release|\bbuild|example|\bcommits?\b|revision|checksum|digest|\bsha-?[0-9]*\b|\bmd5|\buuid|\bguid|\betag|\border\b|invoice|\bmodel\b|"
    r"serial|catalogue?|\bparts?\b|\bitem\b|\barticle|treaty|agreement|regulation|\bdated\b|published|updated|edition|\bfilm|\bnovel|\bstory|\bpath\b|\bfile\b",
    re.IGNORECASE,
)
#: Look-alikes: every candidate in them is of the negative class.
DECOYS = (
    "released as version 10.2.0.14 of the build", "figure 4.10.200.7 and section 2.12.3.1 of the manual", "published 2019-05-12 by the office", "the agreement dated 03/11/2004 was long", "page updated on March 4, 2015 again",
    "the old 14.07.1989 edition of the map", "they met on 21/09/1971 in spring", "between 1987-04-03 and 1990-11-02 it rained", "invoice 555-201-3344 is open", "model 800-555-0199 in the catalogue", "a ratio of 410-555-7788 units",
    "serial number 219-09-9998 on the back", "item 078-05-1121 of the list", "the code 457-55-5462 is old", "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b fixes it", "reverts a94a8fe5ccb19ba61c4c0873d391e987982fbbd3 again",
    "sha256 e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855 matches", "etag 5d41402abc4b2a76b9719d911017c592 sent", "row 123e4567-e89b-12d3-a456-426614174000 was read", "in /home/projects/release2021/main_window/src1 there",
    "see https://site.example/articles/2020/09/15/summary-of-events1 for more", "open USER_PROFILE_PAGE_2023_FINAL_v2 now", "the token field_name_number_17_of_the_form is empty", "key: default-layout-for-page-2-wide", "internationalisation2024edition of it",
    "Maria Theresa reigned for long", "when Jean Jacques wrote it", "Peter Pan is a story", "in San Juan Carmen Bay lies", "the film 10 Cloverfield Lane ran", "a novel, 42 Long Winding Road", "gauge 1234 5678 9012 3456 read", "id 1111-2222-3333-4444 is taken",
    "write a(at)b.cd in the formula", "vector x (at) point.one (dot) two", "grid 1:2:3:4:5:6:7:8 was drawn", "article AB12 3456 7890 1234 of the catalogue", "part ZX99 1111 2222 3333 4444 fits",
)
TOKEN = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            out.append((start, free, "email"))
        at = text.find("@", max(at + 1, free))
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], BASE.index(x[2])))


def mixture(s: str) -> int:
    """Of digits, small and capital letters: how many kinds are in s."""
    return any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s)


def valid(kind: str, s: str) -> int:
    """Regex and checksum labeler."""
    if kind == "iban":
        plain = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    if kind == "ssn":
        a, b, c = s.split("-")
        return -1 if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000" else 1
    if kind == "birth_date":
        numbers = [int(x) for x in re.findall(r"[0-9]+", s)]
        return 1 if all(0 < x <= 31 for x in numbers if x < 1900) and max(numbers) <= 2025 else -1
    if kind in ("local_phone", "phone"):
        return -1 if len(set(DIGIT.findall(s))) < 3 else 1
    if kind == "secret":  # no words joined by signs, no word with a number after it, but many different characters mixed
        if max(map(len, re.split(r"[_/+-]", s.rstrip("=")))) < 16 or re.fullmatch(r"[A-Za-z]+[0-9]+", s) or len(set(s)) < 8:
            return -1
        return 1 if HEX.fullmatch(s) or (mixture(s) > 1 and len(set(s)) >= 9) else 0
    if kind in ("card", "card_like"):
        return 1 if luhn("".join(DIGIT.findall(s))) else -1
    if kind == "ip":
        return -1 if s.startswith("0.") or s.endswith(".0") else 1
    return 0


def known(kind: str, s: str) -> int:
    """Gazetteer labeler."""
    words = TOKEN.findall(s)
    if kind == "person":  # a given name after a title; without one it is what makes the candidate
        return 1 if words[0] in TITLES and any(w in GIVEN for w in words[1:]) else 0
    if kind in ("spelled_email", "email"):
        return 1 if words[-1].lower() in ("com", "org", "net", "edu", "de", "fr", "es", "eu", "io") else -1
    if kind in ("card", "card_like"):
        return 1 if s[0] in "3456" else -1
    if kind == "secret":
        return 1 if s.startswith(SECRET_PREFIX) else 0
    return 0


def cued(kind: str, before: str) -> int:
    """Context labeler: a cue word shortly before."""
    words = {w.lower() for part in TOKEN.findall(before) for w in (part, *part.split("_"))}
    return 1 if any(c in words for c in CUES[kind]) else 0


def plain_context(before: str, after: str) -> int:
    """Context labeler against: versions, licences, references."""
    return -1 if NOT_PERSONAL.search(before[-28:]) or NOT_PERSONAL.search(after[:16]) else 0


def formed(kind: str, s: str, before: str) -> int:
    """Regex labeler of form: a title or an introduction, brackets or spacing that the kind is written with, or an assignment."""
    if kind == "person":
        return 1 if s.split(" ")[0].rstrip(".") in TITLES or INTRODUCED.search(before) else 0
    if kind in ("local_phone", "iban", "phone"):
        return 1 if " " in s or "(" in s else 0
    if kind == "secret":
        return 1 if ASSIGNED.search(before) or TOKEN_FORMS.fullmatch(s) else -1 if "/" in s and before[-1:] in ("/", ":", ".") else 0
    return 0


LABELERS = 5
SHAPES = 6
Pattern = tuple[int, ...]  # number of the kind, then the votes, then the shape


def shape(s: str, before: str, after: str) -> tuple[int, ...]:
    """What the classifier sees besides the votes, in few values each."""
    digits = sum(c.isdigit() for c in s)
    return (
        min(3, len(s) // 12), 4 * digits // (len(s) + 1), mixture(s), int(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        int(before[-1:].isalnum() or after[:1].isalnum()), int(not before.strip() or before.rstrip()[-1] in ".!?:="),
    )


def judged(text: str, start: int, end: int, kind: str) -> Pattern:
    s, before, after = text[start:end], text[max(0, start - 48) : start], text[end : end + 24]
    return (KINDS.index(kind), valid(kind, s), known(kind, s), cued(kind, before), plain_context(before, after), formed(kind, s, before), *shape(s, before, after))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, Pattern]]:
    """(start, end, kind, pattern) of further candidates that touch no base span, leftmost first, without overlap."""
    found = []
    if DIGIT.search(text):
        found += [(m.start(), m.end(), kind) for kind, p in PATTERNS.items() for m in p.finditer(text)]
        found += [(m.start(), m.end(), "secret") for m in SECRET.finditer(text) if DIGIT.search(m.group()) and mixture(m.group()) > 1]
    if "(at)" in text.lower() or "[at]" in text.lower():
        found += [(m.start(), m.end(), "spelled_email") for m in SPELLED.finditer(text)]
    found += [(m.start(), m.end(), "person") for m in PERSON.finditer(text)]
    out, free, i = [], 0, 0
    for start, end, kind in sorted(found, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        while i < len(base) and base[i][1] <= start:
            i += 1
        touched = [b for b in base[i : bisect_left(base, (end, 0, ""), i)] if start < b[1]]
        if start < free or any(kind != "secret" or b[0] <= start and end <= b[1] for b in touched):
            continue
        out.append((start, end, kind, judged(text, start, end, kind)))
        free = end
    return out


#: Counts that a labeler's reliability begins with, P(against, abstain, for | class): better than chance; for one kind, abstaining says little.
BETTER_THAN_CHANCE = 10 * np.array([[0.4, 0.4, 0.2], [0.05, 0.4, 0.55]])
OF_A_KIND = 8 * np.array([[0.35, 0.6, 0.05], [0.05, 0.55, 0.4]])


def expectation_maximisation(votes: np.ndarray, n: np.ndarray, rounds: int = 50, negative: np.ndarray | None = None, start: np.ndarray = BETTER_THAN_CHANCE, against: float = 1) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each row of votes, reliabilities P(vote | class) by labeler, class, vote + 1); n rows each, those in `negative` known to be none.

    Two classes, labelers independent given the class. It begins with the majority; prior counts (start; one row for and
    `against` rows against) tell which class is which.
    """
    negative = np.zeros(len(votes), dtype=bool) if negative is None else negative
    at, labelers = votes + 1, votes.shape[1]
    post = np.where(negative, 0.0, 1 / (1 + np.exp(-1.5 * votes.sum(axis=1) + 0.5)))
    rel = np.full((labelers, 2, 3), 1 / 3)
    for _ in range(rounds):
        rel = np.tile(start, (labelers, 1, 1))
        for j in range(labelers):
            rel[j, 1] += np.bincount(at[:, j], weights=n * post, minlength=3)
            rel[j, 0] += np.bincount(at[:, j], weights=n * (1 - post), minlength=3)
        rel /= rel.sum(axis=2, keepdims=True)
        prior = (1 + (n * post).sum()) / (1 + against + n.sum())
        odds = np.log(prior / (1 - prior)) + sum(np.log(rel[j, 1, at[:, j]] / rel[j, 0, at[:, j]]) for j in range(labelers))
        post = np.where(negative, 0.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    return post, rel


@lru_cache(maxsize=1)
def decoys() -> dict[Pattern, int]:
    """Patterns of the candidates in DECOYS, and how often each is there."""
    counts: Counter[Pattern] = Counter()
    for text in DECOYS:
        base = base_spans(text)
        counts.update(judged(text, s, e, k) for s, e, k in base)
        counts.update(c[3] for c in candidates(text, base))
    return dict(counts)


def features(patterns: np.ndarray) -> np.ndarray:
    """Kind, votes, votes by kind and shape as zeros and ones, and a constant."""
    kind, votes, form = np.eye(len(KINDS))[patterns[:, 0]], patterns[:, 1 : 1 + LABELERS] + 1, patterns[:, 1 + LABELERS :]
    said = np.concatenate([np.eye(3)[votes[:, j]] for j in range(LABELERS)], axis=1)
    own = (kind[:, :, None] * said[:, None, :]).reshape(len(patterns), -1)
    return np.concatenate([kind, said, own, *[np.eye(4)[form[:, j]] for j in range(SHAPES)], np.ones((len(patterns), 1))], axis=1)


@dataclass
class Model:
    """The classifier's weights, the labelers' reliabilities by kind, and how many spans of each kind are likely by their votes."""

    weights: np.ndarray | None = None
    reliability: np.ndarray = field(default_factory=lambda: np.full((len(KINDS), LABELERS, 2, 3), 1 / 3))
    evidence: np.ndarray = field(default_factory=lambda: np.zeros(len(KINDS)))
    known: dict[Pattern, float] = field(default_factory=dict)

    def probability(self, pattern: Pattern) -> float:
        if self.weights is None or self.evidence[pattern[0]] < 1:
            return 0.0
        if pattern not in self.known:  # as many as there are patterns at most
            self.known[pattern] = float(1 / (1 + np.exp(-(features(np.array([pattern])) @ self.weights)[0])))
        return self.known[pattern]


def train(counts: dict[Pattern, int], rounds: int = 50, steps: int = 1500) -> Model:
    """Reliabilities of each kind by expectation-maximisation, then a logistic classifier of spans on its probabilities.

    Decoys weigh as much as the kind's candidates, and ten at least. evidence counts what the votes make more likely than not.
    """
    if not counts:
        return Model()
    known = decoys()
    patterns = np.array([*sorted(counts), *sorted(known)])
    negative = np.arange(len(patterns)) >= len(counts)
    n = np.array([*(counts[p] for p in sorted(counts)), *(known[p] for p in sorted(known))], dtype=float)
    post, model = np.zeros(len(patterns)), Model()
    for k in range(len(KINDS)):
        own = patterns[:, 0] == k
        if own.any():
            of = n[own & ~negative].sum()
            n[own & negative] *= max(10.0, of) / max(1.0, n[own & negative].sum())
            post[own], model.reliability[k] = expectation_maximisation(patterns[own, 1 : 1 + LABELERS], n[own], rounds, negative[own], OF_A_KIND, against=3)
            model.evidence[k] = (n * post)[own & ~negative & (post > 0.5)].sum()
    x = features(patterns)
    w, weight = np.zeros(x.shape[1]), np.log1p(n) / np.log1p(n).sum()  # frequent patterns count more, but do not drown the others
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (weight * (p - post)) + 1e-4 * w)
    model.weights = w
    return model


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count vote patterns over all of docs and train."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter[Pattern] = Counter()
        for t in batch.column("text").to_pylist():
            if t:
                base = base_spans(t)
                counts.update(judged(t, s, e, k) for s, e, k in base)
                counts.update(c[3] for c in candidates(t, base))
        return pa.RecordBatch.from_arrays([pa.array([list(p) for p in counts], pa.list_(pa.int64())), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    rows = map_batches(docs.select(F.col(text_col).cast("string").alias("text")), run, "pattern array<long>, n long", by="text", most=4 << 20).groupBy("pattern").agg(F.sum("n").alias("n"))
    return train({tuple(r.pattern): r.n for r in rows.collect()})  # bounded by the combinations of kind, votes and shape


def spans(text: str | None, model: Model, accept: float = ACCEPT) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text, by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [(s, e, k) for s, e, k, p in candidates(text, base) if model.probability(p) >= accept]
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base_spans, spans): spans as comma-joined kind:start:end."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans(t, shared.value) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(a) for _, a in found], pa.string())], ["doc_id", "base_spans", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, base_spans string, spans string", by="text", most=4 << 20)


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of find()'s rows."""
    n = lambda kind: F.size(F.filter(F.split("base_spans", ","), lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    every = F.filter(F.split("spans", ","), lambda x: x != "")
    n_secret = F.size(F.filter(every, lambda x: x.startswith("secret:"))).cast("long").alias("n_secret")
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2("base_spans", 256).alias("base_sha256"), "spans", n_secret, F.size(every).cast("long").alias("n_spans"))


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with [KIND] for each span; overlapping spans become one, named after the first."""
    out, at = [], 0
    for s, e, k in found:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with masked texts; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else masked(t, spans(t, shared.value)[1]) for t in batch.column(text_col).to_pylist()]
        i = batch.schema.get_field_index(text_col)
        return batch.set_column(i, text_col, pa.array(texts, pa.string()))

    return map_batches(docs, run, docs.schema, by=text_col, most=4 << 20)
