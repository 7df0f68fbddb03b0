"""Encoding against the tokenizers library; exact round trips."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from packetloom.llm.bpe import LATIN_PATTERN, PATTERN, Codec, bpe_decode, bpe_encode
from packetloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return Codec(f.read())


def test_same_ids_as_the_library(codec, library):
    rng = random.Random(5)
    letters = "abcaaa  the ing\n\t'sll0159ñüß.,|%<>…日本語кот \u0085 \x1c\x1f᠎​😀é<|endoftext|>"
    texts = ["", " ", "a" * 3000, "aab" * 500 + "aaaaa", "b" + "a" * 777, "ab" * 999, "<|endoftext|>x<|endoftext|><|endoftext|>", "<|endof", " \n \n  x", "don't we'll"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    texts += ["".join(rng.choice("abeinrst") for _ in range(rng.randint(1, 200))) for _ in range(1000)]
    texts += [f"{x}<|endoftext|> {x}" for x in texts[-50:]]
    ids = [x.tolist() for x in codec.encode(texts)]
    assert ids == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [codec.decode(x) for x in ids] == texts == library.decode_batch(ids, skip_special_tokens=False)


def test_latin_pattern_is_the_general_one():
    every, latin = regex.compile(PATTERN), re.compile(LATIN_PATTERN)
    rng = random.Random(8)
    for i in range(0x250):
        text = f"a{chr(i)}1 {chr(i)}{chr(i)} '{chr(i)} .{chr(i)}s"
        assert every.findall(text) == latin.findall(text), i
    for _ in range(3000):
        text = "".join(rng.choice("  \n\t\xa0\x85\x1c'sdlrevm.,1²½aßÿ") for _ in range(30))
        assert every.findall(text) == latin.findall(text)


def test_invalid_bytes_decode_like_the_library(codec, library):
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(1, 12))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "one two", 5), (3, "one two", 5), (None, "x", 5), (4, "long " * 200_000, 5)], "doc_id long, text string, ids int")
    made = bpe_encode(docs, PATH)
    got = sorted(((r.doc_id, r.ids) for r in made.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    assert [x for _, x in got][:4] == [[], [], [505, 734], [505, 734]] and got[-1][0] is None and len(got) == 6
    back = {r.doc_id: r.text for r in bpe_decode(made, PATH).collect()}
    assert back == {1: "", 2: "", 3: "one two", 4: "long " * 200_000, None: "x"}
    assert bpe_encode(docs.limit(0), PATH).count() == 0


def test_query(spark, small, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {tuple(r) for r in QUERIES["op10_bpe_pair_index"](spark, small).collect()}
    want = {(i, len(ids := library.encode(t, add_special_tokens=False).ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for i, t in texts.items()}
    assert got == want
