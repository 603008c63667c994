import random

import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from factloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    """Several pieces of new words, a piece of empty texts, long words, adjacent merges and special signs."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlé") for _ in range(rng.randint(1, 14)))
    rows = [" ".join(word() for _ in range(30_000)) for _ in range(8)]
    long = ["aaaaaaaaaaaaab" * 40, "  x" + "na" * 500, "<|endoftext|> é́ Σσς 12,5", "the theee thethethe " * 3]
    return [rows[0], "x" * (bpe.PIECE_BYTES + 5), "", None, "", *rows[1:], *long, None, *rows[:2], *long]


def test_the_words_of_many_pieces_are_encoded_together(monkeypatch):
    calls, encode = [], bpe.Vocabulary.encode
    monkeypatch.setattr(bpe.Vocabulary, "encode", lambda self, words: calls.append(len(words)) or encode(self, words))
    rows = texts()
    bpe.load.cache_clear()
    found = list(bpe.coded(iter([pa.RecordBatch.from_pydict({"text": pa.array(rows, pa.string())})]), PATH, "text"))
    bpe.load.cache_clear()
    size = sum(len(x.encode()) for x in rows if x)
    assert len(found) > size / bpe.PIECE_BYTES - 1 and len(calls) <= 1 + size // (2 << 20)
    library = Tokenizer.from_file(PATH)
    got = [ids for _, piece in found for ids in piece.to_pylist()]
    assert [x for piece, _ in found for x in piece.column("text").to_pylist()] == rows
    assert got == [library.encode(x or "", add_special_tokens=False).ids for x in rows]


def test_groups_without_words_and_words_over_the_bound(monkeypatch):
    monkeypatch.setattr(bpe, "WORD_BYTES", 50)
    monkeypatch.setattr(bpe, "KEPT", 5)
    rows = ["", None, " "], ["one two three " * 20, None, "four " + "five" * 60], [None]
    bpe.load.cache_clear()
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(r, pa.string())}) for r in rows]
    got = [ids for _, piece in bpe.coded(iter(batches), PATH, "text") for ids in piece.to_pylist()]
    bpe.load.cache_clear()
    library = Tokenizer.from_file(PATH)
    assert got == [library.encode(x or "", add_special_tokens=False).ids for r in rows for x in r]
