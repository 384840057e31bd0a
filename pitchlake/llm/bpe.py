"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are leaves; each node holds the smallest (rank, place) of the
pairs below it, so the root is the leftmost pair of lowest rank. A merge
rewrites three leaves and their paths to the root, until the root holds no
mergeable pair: n symbols take O(n log n).

The vocabulary file names the normalisation (NFC, white space, lower case), the
split and the end-of-word suffix; the file itself is read on each executor from
the installed package, or from a given path there. Texts of all scripts are
normalised and split here. Only a text with a character that Python's Unicode
tables do not have yet (whose class the library may know) is normalised and split
by the library: for every other character the two agree, which a test goes
through. Words repeat, so a task keeps the encodings of words up to CACHE_BYTES;
nothing stays in the worker when the task ends.

Defined results: a null text is empty (no tokens, empty decoded text); special
tokens' strings in a text are those tokens; a very long text is encoded whole;
equal pairs merge from the left; repeated rows each get a row; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitchlake.llm.common import id_text, map_batches

CACHE_BYTES = 48 << 20
VOCABULARY = "word_bpe_49k.json"
#: White space as the vocabulary's normaliser has it, and the class of words that it splits.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Places take 32 bits, more than a text in Arrow can have bytes; with a rank of 20 bits a leaf fits in 64.
PLACE_BITS, ID_BITS = 32, 20
NONE = 1 << 20  # rank of no mergeable pair
STOP = NONE << PLACE_BITS
#: Words of more symbols are merged on their own.
TOGETHER = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


@lru_cache(maxsize=1)
def classes() -> dict[str, str]:
    """Inner parts of character classes: letters, numbers and characters without a category, as Python's Unicode tables have them."""
    ranges: dict[str, list[list[int]]] = {"L": [], "N": [], "Cn": []}
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))
        own = ranges["Cn" if kind == "Cn" else kind[0]] if kind == "Cn" or kind[0] in "LN" else None
        if own is not None:
            if own and own[-1][1] == code - 1:
                own[-1][1] = code
            else:
                own.append([code, code])
    return {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in ranges.items()}


def merged(symbols: list[int], rank_of: dict[int, int], made: np.ndarray) -> list[int]:
    """The word's symbols after all merges, by a segment tree over its adjacent pairs.

    rank_of maps a pair (left << ID_BITS | right) to its rank, made a rank to its symbol; a leaf is a pair's rank and place.
    """
    n, get = len(symbols), rank_of.get
    size = 1 << max(0, n - 2).bit_length()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    level = [get(symbols[i] << ID_BITS | symbols[i + 1], NONE) << PLACE_BITS | i for i in range(n - 1)]
    level += [STOP] * (size - n + 1)
    tree = level
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        tree = level + tree
    tree = [STOP, *tree]
    while (top := tree[1]) < STOP:
        i = top & (1 << PLACE_BITS) - 1
        j = after[i]
        k = after[i] = after[j]
        new = symbols[i] = int(made[top >> PLACE_BITS])
        if k < n:
            before[k] = i
            changed = [(i, get(new << ID_BITS | symbols[k], NONE) << PLACE_BITS | i), (j, STOP)]
        else:  # the pair was the last; j is the last symbol, or the start of the last pair that is gone
            changed = [(i, STOP), (j, STOP)] if j < n - 1 else [(i, STOP)]
        if (b := before[i]) >= 0:
            changed.append((b, get(symbols[b] << ID_BITS | new, NONE) << PLACE_BITS | b))
        for at, leaf in changed:
            at += size
            tree[at] = leaf
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                if b < a:
                    a = b
                if tree[at] == a:
                    break
                tree[at] = a
                at >>= 1
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


def merged_together(words: list[list[int]], bpe: Bpe) -> list[np.ndarray]:
    """merged() of many short words at once: the same trees, one a row, each step for all rows that still have a pair."""
    n = np.array([len(w) for w in words])
    size = 1 << max(0, int(n.max()) - 2).bit_length()
    every, m = np.arange(len(words)), len(words)
    symbols = np.zeros((m, size + 1), dtype=np.int64)
    symbols[np.repeat(every, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = [x for w in words for x in w]
    after = np.tile(np.arange(1, size + 2), (m, 1))
    before = after - 2
    tree = np.full((m, 2 * size), STOP)
    place = np.arange(size)
    tree[:, size:] = np.where(place < n[:, None] - 1, bpe.ranks(symbols[:, :-1], symbols[:, 1:]) << PLACE_BITS | place, STOP)
    at = size
    while at > 1:
        at >>= 1
        tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])

    def put(rows: np.ndarray, places: np.ndarray, leaves: np.ndarray | int) -> None:
        at = places + size
        tree[rows, at] = leaves
        for _ in range(size.bit_length() - 1):
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    live = every
    while len(live := live[tree[live, 1] < STOP]):
        top = tree[live, 1]
        i, new = top & (1 << PLACE_BITS) - 1, bpe.made[top >> PLACE_BITS]
        j = after[live, i]
        k = after[live, j]
        symbols[live, i], after[live, i] = new, k
        inner = k < n[live]
        before[live[inner], k[inner]] = i[inner]
        right = np.where(inner, bpe.ranks(new, symbols[live, np.minimum(k, size)]), NONE)
        put(live, i, right << PLACE_BITS | i)
        gone = j < n[live] - 1
        put(live[gone], j[gone], STOP)
        b = before[live, i]
        left = b >= 0
        put(live[left], b[left], bpe.ranks(symbols[live[left], b[left]], new[left]) << PLACE_BITS | b[left])
    there = np.zeros((m, size + 1), dtype=bool)  # symbols that are left: those at the end of a chain of places
    at = np.zeros(m, dtype=np.int64)
    while (going := at < n).any():
        there[every[going], at[going]] = True
        at[going] = after[every[going], at[going]]
    ids = symbols[there].astype("<u4")
    return np.split(ids, np.cumsum(there.sum(axis=1))[:-1])


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([self.vocab[a] << ID_BITS | self.vocab[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.rank = np.argsort(keys)
        self.keys = keys[self.rank]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.split_special = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != SPLIT:
            raise ValueError(f"the vocabulary splits words by {pattern}, not by {SPLIT}")
        inner = classes()
        self.split = re.compile(SPLIT.replace(r"\p{L}", inner["L"]).replace(r"\p{N}", inner["N"]).replace(r"\s", SPACE))
        # what str.split() takes for white space, and the vocabulary does not
        self.separators, self.space = re.compile(r"[\x1c-\x1f]"), re.compile(f"[{SPACE}]+")
        self.beyond_latin, self.unknown = re.compile(r"[^\x00-\u02ff]"), re.compile(f"[{inner['Cn']}]")
        self.letters = byte_letters()
        self.byte = {x: b for b, x in enumerate(self.letters)}
        self.first = [self.vocab[x] for x in self.letters]
        self.last = [self.vocab[x + self.suffix] for x in self.letters]
        self.path = path
        self.cache: dict[str, bytes] = {}
        self.held = 0

    @property
    def steps(self):
        """The library's normaliser and splitter, loaded when a text needs them."""
        if not hasattr(self, "_steps"):
            from tokenizers import Tokenizer

            self._steps = Tokenizer.from_file(self.path)
        return self._steps

    def is_unknown(self, text: str) -> bool:
        return bool(self.beyond_latin.search(text) and self.unknown.search(text))

    def pieces(self, text: str) -> list[str]:
        """The normalised text's parts between white space; words never go over one."""
        if self.is_unknown(text):
            parts = self.steps.pre_tokenizer.pre_tokenize_str(self.steps.normalizer.normalize_str(text))
            return [bytes(map(self.byte.__getitem__, part)).decode("utf-8") for part, _ in parts]
        # capital sigma has one small form here, also at the end of a word
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        return [x for x in self.space.split(text) if x] if self.separators.search(text) else text.split()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE where they do not merge."""
        key = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        symbols = [self.first[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return symbols

    def keep(self, text: str, ids: bytes) -> None:
        self.cache[text] = ids
        self.held += len(text) + len(ids) + 200  # about what an entry takes

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces (little-endian 32-bit numbers) in the cache."""
        split = {p: [p] if self.is_unknown(p) else self.split.findall(p) for p in pieces}
        new = {w: self.symbols(w) for ws in split.values() for w in ws if w not in self.cache}
        by_size: dict[int, list[str]] = {}
        for w, symbols in new.items():
            if len(symbols) > TOGETHER:
                self.keep(w, np.array(merged(symbols, self.rank_of, self.made), dtype="<u4").tobytes())
            else:
                by_size.setdefault(len(symbols).bit_length() if len(symbols) > 2 else len(symbols), []).append(w)
        for size, words in by_size.items():
            for i in range(0, len(words), 1 << 13):
                part = words[i : i + (1 << 13)]
                ids = merged_together([new[w] for w in part], self) if size > 1 else [np.array(new[w], dtype="<u4") for w in part]
                for w, x in zip(part, ids, strict=True):
                    self.keep(w, x.tobytes())  # a copy: the array holds its whole part
        for p, ws in split.items():
            if ws != [p]:
                self.keep(p, b"".join([self.cache[w] for w in ws]))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        parts: list[list[list[str] | bytes]] = []  # of each text: pieces of plain text and ids of special tokens, in turn
        for text in texts:
            at, own = 0, []
            for m in self.split_special.finditer(text) if "<|" in text else ():
                own += [self.pieces(text[at : m.start()]), np.array([self.special[m.group()]], dtype="<u4").tobytes()]
                at = m.end()
            parts.append([*own, self.pieces(text[at:])])
        self.learn({p for own in parts for x in own if isinstance(x, list) for p in x if p not in self.cache})
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join([x if isinstance(x, bytes) else b"".join(map(get, x)) for x in own]), dtype="<u4") for own in parts]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces: the vocabulary names no decoder."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def load(path: str) -> Bpe:
    return Bpe(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What encode_documents can return: Spark type, Arrow type, value of (ids, decoded text).
OUTPUTS = {
    "ids": ("array<int>", pa.list_(pa.int32()), lambda ids, text: ids.astype(np.int32)),
    "decoded": ("string", pa.string(), lambda ids, text: text()),
    "n_tokens": ("long", pa.int64(), lambda ids, text: len(ids)),
    "ids_sha256": ("string", pa.string(), lambda ids, text: hashlib.sha256(ids.tobytes()).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda ids, text: hashlib.sha256(text().encode("utf-8")).hexdigest()),
}


def encode_documents(docs: DataFrame, path: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *outputs) of each document, encoded and decoded again; outputs are names in OUTPUTS."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path or vocabulary_path())
        columns: dict[str, list] = {name: [] for name in outputs}
        for ids in bpe.encode_all([text or "" for text in batch.column("text").to_pylist()]):
            decoded = lru_cache(maxsize=1)(lambda ids=ids: bpe.decode(ids))
            for name in outputs:
                columns[name].append(OUTPUTS[name][2](ids, decoded))
        arrays = [pa.array(columns[name], OUTPUTS[name][1]) for name in outputs]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *outputs])

    return map_batches(id_text(docs, id_col, text_col), run, ", ".join(["doc_id long", *(f"{name} {OUTPUTS[name][0]}" for name in outputs)]), by="text", most=4 << 20, at_end=load.cache_clear)
