"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch lie end to end in one array of linked symbols.  An index maps each pair's
rank to all positions of the pair; ranks that occur are applied in ascending order, each at all its
positions at once, and the lists of the pairs that arise or go are updated.  Texts are then gathered from
their words' ids.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T
from tokenizers import Tokenizer

from factloom.llm.common import configure, give_back, pieces, ragged, release, text_bytes, with_columns

#: Words a Python worker keeps (as Arrow arrays, some forty bytes each), and the longest one kept.
KEPT = 200_000
KEPT_CHARS = 64
#: Bytes of text whose new words are encoded together, and of such words at once: every rank that occurs costs the same
#: few calls however many words there are, but each byte of a word takes some fifty bytes of positions.
GROUP_BYTES = 2 << 20
WORD_BYTES = 1 << 18
#: Bytes of text that are split into words at once: as Python strings and positions they take some thirty times as much.
PIECE_BYTES = 1 << 20
#: White space and the word pattern of the vocabulary: fixed values.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+"


class Signs:
    """Words and small letters by the Unicode version of the vocabulary's library, which lies between
    those of Python and of the pattern module: it is asked about the characters they disagree on."""

    def __init__(self, library: Tokenizer):
        signs = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
        newer = [c for c in signs if unicodedata.category(c) == "Cn"]
        parts = {c: len(library.pre_tokenizer.pre_tokenize_str(f"a{c}{c}a")) for c in newer}
        unknown = "".join(c for c in newer if parts[c] != (1 if regex.match(r"\p{L}", c) else 4))
        small = {c: library.normalizer.normalize_str(c) for c in newer}
        self.small = str.maketrans({c: s for c, s in small.items() if c != s})
        self.newer = frozenset(newer)
        # Plain characters: the same pattern for the faster module.
        self.plain = re.compile(WORD.format(letter="a-z", number="0-9", space=r"\t-\r "))
        self.word = regex.compile(WORD.format(letter=r"\p{L}", number=r"\p{N}", space=SPACE))
        old = {name: rf"[{kind}--[{unknown or chr(0x10FFFF)}]]" for name, kind in (("letter", r"\p{L}"), ("number", r"\p{N}"))}
        self.strict = regex.compile(WORD.replace("[{number}]", "{number}").replace("[{letter}]+", "{letter}+").format(**old, space=SPACE), regex.V1)

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not self.newer.isdisjoint(text):
            return self.strict.findall(text.translate(self.small))
        return self.word.findall(text)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        self.signs = Signs(Tokenizer.from_file(path))  # the library is gone before the tables are made
        release()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for table in (vocab, self.special):
            for text, i in table.items():
                self.token[i] = text
        self.inner = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.final = np.array([vocab[c + end] for c in byte_letters()], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = self.left * len(self.token) + self.right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order
        self.none = len(merges)
        self.mark = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = pa.array([], pa.string())
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.keep(pa.array(list(self.special), pa.string()), np.array(list(self.special.values()), np.int32), np.ones(len(self.special), np.int64))

    def keep(self, words: pa.StringArray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember the ids of words for later batches."""
        self.known = pa.concat_arrays([self.known, words])
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``none`` where it has none."""
        key = left.astype(np.int64) * len(self.token) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def words_of(self, text: str) -> list[str]:
        """The text's words, normalized (NFC, lower case), and special tokens as they are."""
        if self.mark and "<|" in text:
            parts = self.mark.split(text)
            return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.signs.words(part))]
        return self.signs.words(text)

    def encode(self, words: pa.StringArray | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.string())
        found, row = [(np.zeros(0, np.int32), np.zeros(0, np.int64))], 0
        _, at = text_bytes(words)
        while row < len(words):
            end = max(row + 1, int(np.searchsorted(at, at[row] + WORD_BYTES, "right")) - 1)
            found.append(self.encode_some(words.slice(row, end - row)))
            row = end
        return tuple(np.concatenate(x) for x in zip(*found))

    def encode_some(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        codes, ends = text_bytes(words)
        ends, lengths = ends[1:], np.diff(ends)
        n = len(codes)
        symbol = self.inner[codes]
        symbol[ends - 1] = self.final[codes[ends - 1]]
        start = symbol.copy()
        owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            real = ranks < self.none
            ranks, places = ranks[real], places[real]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for i, rank in enumerate(ranks[cuts[:-1]].tolist()):
                some = places[cuts[i] : cuts[i + 1]]
                if rank in index:
                    index[rank].append(some)
                else:
                    index[rank] = [some]
                    heapq.heappush(active, rank)

        inside = np.flatnonzero(after >= 0).astype(np.int32)
        add(self.rank_of(symbol[inside], symbol[inside + 1]), inside)
        again: list[np.ndarray] = []
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = np.concatenate(lists)
            at = at[(symbol[at] == self.left[rank]) & (after[at] >= 0)]
            at = at[symbol[after[at]] == self.right[rank]]
            if not len(at):
                continue
            at.sort()
            at = at[np.append(True, at[1:] != at[:-1])]
            if self.left[rank] == self.right[rank] and len(at) > 1:  # of a run, every other pair
                begin = np.ones(len(at), bool)
                begin[1:] = before[at[1:]] != at[:-1]
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
                at = at[since % 2 == 0]
            merged = self.merged[rank]
            gone = after[at]
            following = after[gone]
            has = following >= 0
            led_to, following = at[has], following[has]
            then = symbol[following]
            symbol[at], symbol[gone] = merged, -1
            after[at] = after[gone]
            before[following] = led_to
            leading = before[at]
            leading = leading[leading >= 0]
            # New pairs with the symbol before and behind; the last ones are those with what stood behind until now.
            places = np.concatenate([leading, led_to, led_to])
            right = np.concatenate([symbol[after[leading]], symbol[following], then])
            ranks = self.rank_of(np.append(symbol[places[: -len(led_to) or None]], np.full(len(led_to), merged, np.int32)), right)
            # A better pair that arises before all places are done would go first: such words are redone.
            better = ranks < rank
            if better.any():
                again.append(owner[places[better]])
            real = len(ranks) - len(led_to)
            add(ranks[:real], places[:real])
        ids, count = symbol[symbol >= 0], np.bincount(owner[symbol >= 0], minlength=len(words))
        if again:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for w in np.unique(np.concatenate(again)).tolist():
                parts[w] = self.one_by_one(start[ends[w] - lengths[w] : ends[w]].tolist())
                count[w] = len(parts[w])
            ids = np.concatenate(parts)
        return ids.astype(np.int32), count.astype(np.int64)

    def one_by_one(self, symbol: list[int]) -> np.ndarray:
        """One word by single merges: lowest rank first, of these the leftmost."""
        n = len(symbol)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        rank = lambda a, b: int(self.rank_of(np.array([symbol[a]]), np.array([symbol[b]]))[0])
        heap = [(rank(i, i + 1), i) for i in range(n - 1)]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if symbol[i] >= 0 else -1
            if r == self.none or j < 0 or symbol[i] != self.left[r] or symbol[j] != self.right[r]:
                continue
            symbol[i], symbol[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                heapq.heappush(heap, (rank(i, after[i]), i))
            if before[i] >= 0:
                heapq.heappush(heap, (rank(before[i], i), before[i]))
        return np.array([s for s in symbol if s >= 0], np.int64)


@lru_cache(2)
def load(path: str) -> Vocabulary:
    made = Vocabulary(path)
    release()
    return made


def coded(batches: Iterator[pa.RecordBatch], vocabulary: str, text_col: str) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """Pieces of the batches with the ids of their texts."""
    v = load(vocabulary)
    for group in pieces(batches, text_col, GROUP_BYTES):
        parts = list(pieces(iter([group]), text_col, PIECE_BYTES))
        split = [numbered(v, part.column(text_col)) for part in parts]
        flat = pa.chunked_array([words for words, _ in split]).unify_dictionaries()
        distinct = flat.chunk(0).dictionary
        place = pc.fill_null(pc.index_in(distinct, v.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = distinct.filter(pa.array(place < 0))
        ids, at = v.ids, v.at
        if len(new):
            found, lengths = v.encode(new)
            place[place < 0] = len(v.known) + np.arange(len(new))
            ids, at = np.concatenate([ids, found]), np.concatenate([at, at[-1] + np.cumsum(lengths)])
            if len(v.known) < KEPT:
                short = pc.less_equal(pc.utf8_length(new), KEPT_CHARS).to_numpy(zero_copy_only=False)
                v.keep(new.filter(pa.array(short)), found[np.repeat(short, lengths)], lengths[short])
            del found, lengths
        del distinct, new
        for part, words, (_, count) in zip(parts, flat.chunks, split):
            number = place[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            size = np.diff(at)[number]
            spread = np.repeat(at[number] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            cuts = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))]
            yield part, ragged(ids[spread], np.diff(cuts), pa.int32())
            del number, size, spread, cuts
        del group, parts, part, split, flat, words, place, ids, at
        release()


def numbered(v: Vocabulary, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The texts' words, one after the other, as numbers of distinct words, and how many each text has."""
    split = [v.words_of(x) if x else [] for x in texts.to_pylist()]
    count = np.array([len(w) for w in split], np.int64)
    return pa.array([w for some in split for w in some], pa.string()).dictionary_encode(), count


def strings_of(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The tokens of each list, joined by one blank; '' for a null list."""
    texts = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens.take(ids.values)), " ")
    return pc.if_else(ids.is_valid(), texts, "")


IDS, TEXT = T.ArrayType(T.IntegerType()), T.StringType()


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text as ``ids_col`` (array<int>).

    ``vocabulary``: path, on every executor, of a byte-level BPE file with an end-of-word suffix, texts in
    NFC and lower case, white space dropped.  Special tokens written in a text become their ids; none are
    added.  Null and empty texts, or ones of white space only, have no ids.  A column named ``ids_col`` is
    replaced, others pass; rows may repeat.
    """
    configure(docs.sparkSession)
    docs = docs.drop(ids_col)

    def run(batches):
        for batch, ids in coded(batches, vocabulary, text_col):
            yield with_columns(batch, {ids_col: ids})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, IDS)]))


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with what ``encode`` gives as ``ids_col`` and what ``decode`` makes of it as ``decoded_col``, in one pass:
    two would hold the vocabulary in two Python workers a task.  Columns of these names are replaced, others pass."""
    configure(docs.sparkSession)
    docs = docs.drop(ids_col, decoded_col)

    def run(batches):
        tokens = pa.array(load(vocabulary).token, pa.string())
        for batch, ids in coded(batches, vocabulary, text_col):
            yield with_columns(batch, {ids_col: ids, decoded_col: strings_of(ids, tokens)})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, IDS), T.StructField(decoded_col, TEXT)]))


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with the vocabulary's strings of ``ids_col``, joined by one blank, as ``text_col``.

    Special tokens stay.  Null and empty lists give ''.  A column named ``text_col`` is replaced.
    """
    configure(tokens.sparkSession)
    tokens = tokens.drop(text_col)

    def run(batches):
        give_back()
        strings = pa.array(load(vocabulary).token, pa.string())
        for batch in batches:
            yield with_columns(batch, {text_col: strings_of(batch.column(ids_col), strings)})

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(text_col, TEXT)]))
