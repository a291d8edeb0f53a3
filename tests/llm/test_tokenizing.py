import base64
import random
import time

import pytest
from tokenizers import Tokenizer

from graphloom.llm.tokenizing import BYTE_BPE_50K, count_tokens, decode_documents, encode_documents
from graphloom.llm.wordbpe import WordEncoder


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(BYTE_BPE_50K)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_random_texts_equal_the_public_tokenizer(public):
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'", "s", "ll", "é", "ß", "中", "\u00a0", "\u3000", "\x1c", "\x85", "\u200b", "1", "٣", "½", "_", "-", "😀", "e\u0301", "\r", "Ⅳ", "\x0b", "re", "ABCdef", "fooBarBaz", "<|endoftext|>", "camelCaseWords", "HTTPServer"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(1500)]
    words = ["".join(rng.choice("aeiourstlnABCDE") for _ in range(rng.randint(2, 14))) for _ in range(1500)]
    encoder = WordEncoder(BYTE_BPE_50K, keep=3000, chunk=500)
    for some in (texts, words, ["a" * 3000, "ab" * 2000, "x" * 9000 + " y"]):
        got = encoder.encode(some)
        assert got == public(some)
        assert encoder.decode(got) == some


def test_composition_equals_the_recursive_query():
    rng = random.Random(5)
    pieces = ["lens", "Anchor", "Re", "Play", "ing", "Ing", "The", "re", "Under", "stand", "able", "ABLE", "x", "Q"]
    words = {"".join(rng.choices(pieces, k=rng.randint(2, 5))) for _ in range(1500)}
    encoder = WordEncoder(BYTE_BPE_50K)
    encoder.learn(words)
    words = sorted(words)
    assert [encoder.ids[w] for w in words] == WordEncoder(BYTE_BPE_50K).merge(words)


def test_scripts_without_blanks_and_very_long_words(public):
    rng = random.Random(9)
    letters = lambda lo, hi, n: "".join(chr(rng.randint(lo, hi)) for _ in range(n))
    texts = {
        "ideographs": "，".join(letters(0x4E00, 0x9FA5, rng.randint(8, 40)) for _ in range(1200)),
        "Thai": "".join(chr(rng.choice([*range(0xE01, 0xE2F), *range(0xE30, 0xE3A), *range(0xE40, 0xE47)])) for _ in range(30_000)),
        "Hangul": " ".join(letters(0xAC00, 0xD7A3, rng.randint(1, 6)) for _ in range(5000)),
        "Cyrillic": letters(0x430, 0x44F, 20_000),
        "base64": base64.b64encode(rng.randbytes(90_000)).decode(),
        "digits": "".join(rng.choice("0123456789") for _ in range(20_000)),
        "one word": "".join(rng.choices(["lens", "ing", "the", "q", "anchor"], k=250_000)),
        "one run": "=-" * 30_000 + "=" * 1_000_000,
    }
    encoder = WordEncoder(BYTE_BPE_50K)
    for name, text in texts.items():
        began = time.process_time()
        assert encoder.encode([text]) == public([text]), name
        assert time.process_time() - began < 10, name


def test_rows_nulls_and_empty_tables(spark, public):
    docs = spark.createDataFrame([(1, "Hello world", 1), (2, None, 2), (3, "", 3), (4, "   ", 4), (4, "   ", 4)], "doc_id bigint, text string, ids int")
    rows = sorted((r["doc_id"], list(r["ids"])) for r in encode_documents(docs).collect())
    space = public(["   "])[0]
    assert rows == [(1, public(["Hello world"])[0]), (2, []), (3, []), (4, space), (4, space)]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in count_tokens(docs).collect()) == [(1, 2), (2, 0), (3, 0), (4, len(space)), (4, len(space))]
    assert encode_documents(docs.limit(0)).count() == 0
    assert {(r["doc_id"], r["text"]) for r in decode_documents(encode_documents(docs)).collect()} == {(1, "Hello world"), (2, ""), (3, ""), (4, "   ")}


def test_every_character_comes_back():
    texts = ["a\x00b", "\x00", "".join(map(chr, range(1, 400))), "\ud7ff\ue000\U0010ffff", ""]
    encoder = WordEncoder(BYTE_BPE_50K)
    assert encoder.decode(encoder.encode(texts)) == texts


def test_a_query_takes_many_short_words_and_few_bytes(public):
    encoder, asked = WordEncoder(BYTE_BPE_50K), []

    class Counting:
        def __init__(self, db):
            self.register, self.unregister = db.register, db.unregister
            self.execute = lambda sql: asked.append(sql) or db.execute(sql)

    encoder._db = Counting(encoder._db)
    numbers = [str(n) for n in range(100_000, 106_000)]
    assert encoder.encode(numbers) == public(numbers) and len(asked) == 1
    asked.clear()
    long = [bytes([65 + n % 26]) * 20_000 for n in range(26)]  # together more bytes than one query takes
    assert [b"".join(encoder.token_bytes[t] for t in row) for row in encoder.contract(long)] == long and len(asked) == 3
