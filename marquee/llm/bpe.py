"""BPE encoding and decoding with a public vocabulary of words with end-of-word marks.

Encoding follows the vocabulary file: special tokens are cut out of the raw text first; the rest is put in
NFC, white space runs become one space, letters are lower-cased one by one, words are taken by the file's
pattern, and each word's UTF-8 bytes are written in the byte alphabet with `</w>` at the last.

Merging: the symbols of all new words of a batch lie in one flat array. In each round every word that still
has a mergeable pair merges its pair of lowest rank: pair keys are looked up by binary search in the sorted
keys of the merge table, the minimum is taken word by word, and all words are merged in the same pass.
Within a round a word merges all non-overlapping places of its pair from the left; only where the file lets
the merged symbol enter a pair of lower rank is it one place a round, so the order is always the library's.
Words are distinct per task as long as its bounded memory lasts, so a frequent word is merged once.

Decoding looks the ids up and joins the pieces with one space, as the file has no decoder.

Edge cases: a null or empty text has no ids and decodes to the empty text; very long words and texts are
encoded whole; repeated rows give equal ids; ids outside the vocabulary decode to nothing; a null id list
decodes to the empty text; an empty table gives no rows; input columns named like an output column are
replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

# The White_Space property, as the file's `\s` has it.
SPACES = "\t-\r \x85\xa0  -     　"
SLICE = 4 << 20              # bytes of text handled at once
CACHED = 150_000             # chunks and words of a generation that a task remembers
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """A printable character for every byte: itself where it is printable, else the next from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    def __init__(self, data: str):
        spec = json.loads(data)
        model = spec["model"]
        ids = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [None] * self.size
        for piece, i in [*ids.items(), *self.special.items()]:
            self.pieces[i] = piece
        letters = byte_alphabet()
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.final = np.array([ids[c + suffix] for c in letters], np.int32)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        first = np.full(self.size, NONE)  # lowest rank of a pair that a symbol is part of
        np.minimum.at(first, left, np.arange(keys.size))
        np.minimum.at(first, right, np.arange(keys.size))
        self.one_by_one = first[made] < np.arange(keys.size)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.left, self.right, self.made = left, right, made
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACES)
        self.words = regex.compile(pattern + "| ", regex.V0)
        self.cut = re.compile("|".join(re.escape(t) for t in self.special))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; NONE if it isn't merged."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _ranks(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place; NONE at the end of a word."""
        after = np.minimum(at + 1, symbols.size - 1)
        return np.where((after > at) & (word[at] == word[after]), self.rank(symbols[at], symbols[after]), NONE)

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each (not empty) word."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[raw[last]]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[np.ndarray | None] = [None] * len(words)
        ranks = self._ranks(symbols, word, np.arange(symbols.size))
        while symbols.size:
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(np.append(starts, symbols.size))
            least = np.minimum.reduceat(ranks, starts)
            for k in np.flatnonzero(least == NONE):  # nothing left to merge
                done[word[starts[k]]] = symbols[starts[k]:starts[k] + lengths[k]]
            low = np.repeat(least, lengths)
            live = low != NONE
            at = np.flatnonzero(live & (ranks == low))
            if not at.size:
                break
            run = np.concatenate(([0], np.cumsum(np.diff(at) > 1)))  # neighbours overlap: every other one counts
            run_starts = np.searchsorted(run, np.arange(run[-1] + 1))
            take = (np.arange(at.size) - run_starts[run]) % 2 == 0
            owner = word[at]
            take &= np.concatenate(([True], owner[1:] != owner[:-1])) | ~self.one_by_one[low[at]]
            at = at[take]
            symbols = symbols.copy()
            symbols[at] = self.made[low[at]]
            live[at + 1] = False
            moved = np.cumsum(live)[at] - 1
            symbols, word, ranks = symbols[live], word[live], ranks[live]
            touched = np.zeros(symbols.size, bool)
            touched[moved] = touched[np.maximum(moved - 1, 0)] = True
            changed = np.flatnonzero(touched)
            ranks[changed] = self._ranks(symbols, word, changed)
        return done


class Memory(dict):
    """A dict in two generations: when it holds CACHED entries they become the old ones, and what was old
    before is forgotten. Entries that are asked for again move to the new generation."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """The keys that are not remembered; after this, all others are in the new generation."""
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()
        lacking = keys.difference(self)
        known = lacking.intersection(self.old)
        self.update((k, self.old[k]) for k in known)
        return lacking.difference(known)


class Encoder:
    """Encodes texts with the memory of one task: ids of chunks (text between white space) and of words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.chunks, self.words = Memory(), Memory()

    def _pieces(self, text: str) -> list[str]:
        """Words of a text, with a space for every space between them."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma has no context here
        return self.vocabulary.words.findall(text.lower())

    def _learn(self, new: set[str]) -> None:
        plain = [c for c in new if "<|" not in c]
        pieces = self._pieces(" ".join(plain))
        special = {c: self._special(c) for c in new if "<|" in c}
        words = set(pieces).union(*([w for w, _ in p] for p in special.values())) - {" ", None}
        todo = list(self.words.missing(words))
        if todo:
            for w, ids in zip(todo, self.vocabulary.merge_words([w.encode() for w in todo])):
                self.words[w] = ids.tobytes()
        ids = self.words
        if len(pieces) == 2 * len(plain) - 1 and " " not in pieces[0::2]:  # one word each
            self.chunks.update(zip(plain, map(ids.__getitem__, pieces[0::2])))
        else:
            cuts = [k for k, w in enumerate(pieces) if w == " "]
            for c, a, b in zip(plain, [0, *(k + 1 for k in cuts)], [*cuts, len(pieces)]):
                self.chunks[c] = ids[pieces[a]] if b - a == 1 else b"".join([ids[w] for w in pieces[a:b]])
        for c, p in special.items():
            self.chunks[c] = b"".join([i if w is None else ids[w] for w, i in p])

    def _special(self, chunk: str) -> list[tuple[str | None, bytes]]:
        """(word, b"") or (None, id of a special token) in order."""
        out, at = [], 0
        for m in self.vocabulary.cut.finditer(chunk):
            out += [(w, b"") for w in self._pieces(chunk[at:m.start()])]
            out.append((None, np.int32(self.vocabulary.special[m[0]]).tobytes()))
            at = m.end()
        return out + [(w, b"") for w in self._pieces(chunk[at:])]

    def batch(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text. ASCII white space cuts chunks; other white space inside a chunk belongs to no
        word of the pattern and cuts words."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        codes = lists.flatten().dictionary_encode()
        distinct = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = self.chunks.missing(set(distinct) - {""})
        if new:
            self._learn(new)
        self.chunks[""] = b""
        found = list(map(self.chunks.__getitem__, distinct))
        ids = np.frombuffer(b"".join(found), np.int32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        code = codes.indices.to_numpy()
        many = sizes[code]
        ends = np.concatenate(([0], np.cumsum(many)))
        at = np.repeat(starts[code] - ends[:-1], many) + np.arange(ends[-1])
        per_text = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.array(ids[at]))


def _shared(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:  # read by the driver only; tasks get it by broadcast
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`docs` with the token ids of the text as an array of ints."""
    shared = _shared(docs.sparkSession, path)
    memory: dict[str, Encoder] = {}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        if "encoder" not in memory:
            memory["encoder"] = Encoder(Vocabulary(shared.value))
        rows = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [memory["encoder"].batch(part.column(0)) for part in slices(rows, "text", SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(ids_col, run(F.col(text_col)))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`encoded` with the text of the ids."""
    shared = _shared(encoded.sparkSession, path)
    memory: dict[str, pa.Array] = {}

    @F.arrow_udf(T.StringType())
    def run(ids: pa.Array) -> pa.Array:
        if "pieces" not in memory:
            memory["pieces"] = pa.array(Vocabulary(shared.value).pieces, pa.string())
        pieces = memory["pieces"]
        out = []
        for start in range(0, len(ids), 256):
            part = pc.fill_null(ids.slice(start, 256), pa.scalar([], ids.type))
            flat = part.flatten()
            known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
            named = pieces.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
            sizes = pc.list_value_length(part).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            if named.null_count:
                texts = [" ".join([p for p in x if p is not None]) for x in
                         pa.ListArray.from_arrays(offsets, named).to_pylist()]
                out.append(pa.array(texts, pa.string()))
            else:
                out.append(pc.binary_join(pa.ListArray.from_arrays(offsets, named), " "))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return encoded.withColumn(text_col, run(F.col(ids_col)))
