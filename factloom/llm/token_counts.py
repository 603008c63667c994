"""Token counts of a sentencepiece BPE model with byte fallback, by rank-synchronous array merging.

A text is cut into pre-tokens (blanks and the word behind them) that no piece crosses.  The pre-tokens
a batch has not met before lie in one ragged numpy array of symbols; in every round each sequence
applies its own best pair, all sequences at once, until none has a pair left.  What counts is the number
of symbols that survive, characters outside the vocabulary as their bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from factloom.llm.common import configure, pieces, with_columns

BLANK = "▁"
#: Counts of pre-tokens a Python worker keeps, and the longest one kept.
KEPT = 200_000
KEPT_CHARS = 64


class Pieces:
    """The vocabulary as tables: symbol of each character, and (left, right) -> (rank, symbol)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        text = {model.id_to_piece(i): i for i in normal}
        score = np.array([model.get_score(i) for i in range(model.get_piece_size())])
        order = np.argsort(-score, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # Pieces with the same score are one rank: the leftmost pair goes first.
        for a, b in zip(order, order[1:]):
            if score[a] == score[b]:
                rank[b] = rank[a]
        self.single = {p: i for p, i in text.items() if len(p) == 1}
        self.base = len(score)
        keys, merged = [], []
        for piece, i in text.items():
            for cut in range(1, len(piece)):
                left, right = text.get(piece[:cut]), text.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    merged.append(i)
        keys, merged = np.array(keys, np.int64), np.array(merged, np.int64)
        by = np.argsort(keys)
        self.keys, self.merged, self.ranks = keys[by], merged[by], rank[merged[by]]
        #: No piece has a blank behind another character, so pre-tokens end before a blank.
        self.splits = not any(BLANK in p.lstrip(BLANK) for p in text)
        self.none = np.iinfo(np.int64).max
        self.cache: dict[str, int] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; the highest rank of all where there is none."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], self.none), self.merged[at]

    def count(self, tokens: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token (its blanks already as BLANK)."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        flat = "".join(tokens)
        codes = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        known, back = np.unique(codes, return_inverse=True)
        ids = np.array([self.single.get(chr(c), -1) for c in known.tolist()], np.int64)
        width = np.array([1 if i >= 0 else len(chr(c).encode()) for c, i in zip(known.tolist(), ids)], np.int64)
        symbols, owner = ids[back], np.repeat(np.arange(len(tokens)), lengths)
        total = np.zeros(len(tokens), np.int64)
        bytes_of = np.bincount(owner, weights=width[back] - 1, minlength=len(tokens)).astype(np.int64)
        while len(symbols):
            # Each sequence's lowest rank, and the first place that has it.
            rank, merged = self.rank_of(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = self.none
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(np.append(rank, self.none), first)
            done = best == self.none
            spread = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
            total += np.bincount(owner, weights=done[spread], minlength=len(tokens)).astype(np.int64)
            hits = np.flatnonzero((rank == best[spread[:-1]]) & (rank != self.none))
            # Every place of that rank at once where this equals left to right: one symbol pair, no
            # overlap, and nothing better arises beside it.  Otherwise the first place only.
            hits = self._safe(hits, symbols, spread, best, merged)
            symbols[hits] = merged[hits]
            keep = ~done[spread]
            keep[hits + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return total + bytes_of

    def _safe(self, hits, symbols, spread, best, merged):
        """The places to merge now: of a sequence's equal pairs all that do not overlap, left to right, if
        no better pair arises meanwhile, else the first."""
        if not len(hits):
            return hits
        group = spread[hits]
        run = np.ones(len(hits), bool)
        run[1:] = (np.diff(hits) != 1) | (np.diff(group) != 0)
        since = np.arange(len(hits)) - np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
        hits = hits[since % 2 == 0]
        group = spread[hits]
        first = np.diff(group, prepend=-1) != 0
        if first.all():
            return hits
        n, symbol, top = len(symbols), merged[hits], best[group]
        before, after = np.maximum(hits - 1, 0), np.minimum(hits + 2, n - 1)
        bad = (hits > 0) & (spread[before] == group) & (self.rank_of(symbols[before], symbol)[0] <= top)
        bad |= (hits + 2 < n) & (spread[after] == group) & (self.rank_of(symbol, symbols[after])[0] <= top)
        beside = (np.diff(hits) == 2) & (np.diff(group) == 0)
        bad[1:] |= beside & (self.rank_of(symbol[:-1], symbol[1:])[0] <= top[1:])
        unsafe = np.zeros(len(best), bool)
        unsafe[group[bad]] = True
        return hits[first | ~unsafe[group]]


@lru_cache(2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _pre_tokens(text: str, pattern) -> list[str]:
    return pattern.findall(" " + text.replace(BLANK, " "))


def count_tokens(docs: DataFrame, model: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with columns n_bytes (UTF-8), n_tokens (long) and over_limit (n_tokens > ``limit``).

    ``model``: path of a sentencepiece BPE model with identity normalization and a blank put before the
    text, present on every executor.  No begin or end token; strings of control tokens are ordinary text.
    Whole texts are counted; null counts as empty, and empty has no token.  Columns of these names are
    replaced, others pass; rows may repeat.
    """
    configure(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    word = re.compile(" *[^ ]+| +")

    def count(batches):
        pieces_of = load(model)
        pattern = word if pieces_of.splits else re.compile("(?s).+")
        for batch in pieces(batches, text_col, 1 << 23):
            known = pieces_of.cache
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            split = [_pre_tokens(t, pattern) if t else [] for t in texts]
            new = sorted(set().union(*split).difference(known))
            found = dict(zip(new, pieces_of.count([t.replace(" ", BLANK) for t in new]).tolist())) if new else {}
            if len(known) < KEPT:
                known.update((t, n) for t, n in found.items() if len(t) <= KEPT_CHARS)
            both = found | known if len(known) < len(found) else known | found
            n_tokens = np.array([sum(map(both.__getitem__, s)) for s in split], np.int64)
            yield with_columns(
                batch,
                {"n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n_tokens), "over_limit": pa.array(n_tokens > limit)},
            )

    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, *new]))
