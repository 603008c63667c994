import random
import sys

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import bpe, token_counts
from factloom.llm.queries import PIECES, WORDS

SF = "/root/testdata/sf0.01/documents.parquet"
ODD = [
    None, "", " ", "   ", "a", " a", "a ", "  two  blanks ", "tab\tand\nline\r\n", "▁ given ▁▁ mark", "<s> </s> <unk> <0x0A>", "é é ﬁ Ⅷ ½ ٣ 你好世界 ",
    "日本語テキスト", "😀😃 👩‍👩‍👧", "a" * 5000, "ab" * 3000, "aab" * 2000, "!?" * 2000, "=" * 777, "    " * 500, "\x00\x01 \x7f", "İstanbul ΣΑΣ Σ ß ẞ Ǆ",
    "don't I'll we've you're 'S 'Re it's", "x<|endoftext|>y <|startoftext|>Z<|endoftext|><|endoftext|>", "<|endoftext|", "1234567 12.5 １２", " nbsp em　wide\x85next\x1cfs​zw",
    "Ṩ q̣̇ ẛ̣", "ⅰⅱ ǅ ſ K Å",
]


def noise(seed, n=150):
    rng = random.Random(seed)
    pools = ["abcdeABCDE  .,'!", "thereionandst   ", "éèüñßçœ \n", "0123456789 -", "漢字かなカナ한글 ", "▁ aA"]
    points = [chr(c) for c in range(sys.maxunicode) if c < 0xD800 or 0xE000 <= c < 0x30000]
    out = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(200))) for _ in range(n)]
    return out + ["".join(rng.choice(points) + rng.choice(" aé.") for _ in range(60)) for _ in range(n)]


def texts(spark):
    given = [r.text for r in spark.read.parquet(SF).select("text").collect()]
    return ODD + noise(1) + given


def table(spark, rows):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(rows)], "doc_id long, text string, n_tokens string").repartition(6)


def test_counts_as_the_library(spark):
    rows = texts(spark)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in token_counts.count_tokens(table(spark, rows), PIECES).collect()}
    assert len(got) == len(rows)
    for k, text in enumerate(rows):
        n = len(model.encode(text or ""))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 4096), text


def test_ids_and_text_as_the_library(spark):
    rows = texts(spark)
    tokenizer = Tokenizer.from_file(WORDS)
    tokens = bpe.decode(bpe.encode(table(spark, rows), WORDS), WORDS)
    got = {r.doc_id: r for r in tokens.collect()}
    for k, text in enumerate(rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert got[k].ids == ids, text
        assert got[k].decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_every_character(spark):
    """One text per block of 64 code points, letters between them."""
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    rows = ["a".join(map(chr, points[k : k + 64])) for k in range(0, len(points), 64)]
    tokenizer = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r.ids for r in bpe.encode(table(spark, rows), WORDS).select("doc_id", "ids").collect()}
    wrong = [k for k, text in enumerate(rows) if got[k] != tokenizer.encode(text, add_special_tokens=False).ids]
    assert wrong == []


def test_other_vocabulary_order():
    """Words in one batch or one by one give the same ids."""
    v = bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    words = sorted({w for t in noise(2) for w in v.words_of(t)})
    ids, lengths = v.encode(words)
    at = 0
    for word, n in zip(words, lengths):
        raw = word.encode()
        start = [int(v.inner[b]) for b in raw[:-1]] + [int(v.final[raw[-1]])]
        assert v.one_by_one(start).tolist() == ids[at : at + n].tolist()
        at += n


@pytest.mark.parametrize("run,columns", [
    (lambda df: token_counts.count_tokens(df, PIECES), ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]),
    (lambda df: bpe.decode(bpe.encode(df, WORDS), WORDS), ["doc_id", "text", "ids", "decoded"]),
])
def test_empty_table(spark, run, columns):
    out = run(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == columns and out.collect() == []


def test_decoded_lists(spark):
    """Null and empty lists, repeated rows and special tokens."""
    rows = [(1, None), (2, []), (3, [49406, 320, 320]), (3, [49406, 320, 320]), (4, None), (5, [320] * 100_000)]
    tokenizer = Tokenizer.from_file(WORDS)
    got = bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>").coalesce(1), WORDS).collect()
    assert sorted((r.k, r.decoded) for r in got) == sorted((k, tokenizer.decode(ids or [], skip_special_tokens=False)) for k, ids in rows)


def test_long_unbroken_words_and_repeated_rows(spark):
    rng = random.Random(5)
    long = ["".join(rng.choice("abcdefghij") for _ in range(40_000)), "é" * 20_000]
    tokenizer = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(table(spark, long * 3), WORDS), WORDS).collect()}
    for k, text in enumerate(long * 3):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got[k].ids == ids and got[k].decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_texts_are_split_into_words_in_small_pieces():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"some words {i} and more of them\n" * 4_000 for i in range(20)]
    found = list(bpe.coded(iter([pa.RecordBatch.from_pydict({"text": texts})]), path, "text"))
    assert len(found) > 1 and all(sum(map(len, b.column("text").to_pylist())) <= 1 << 20 for b, _ in found)
    whole = [x for _, ids in found for x in ids.to_pylist()]
    assert whole == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
