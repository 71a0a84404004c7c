"""Tree concatenation against the tokenizers library, on hostile texts and on the given documents."""

import random
from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

from bookheat.llm.bpe import Codec, decode, encode, unpack
from bookheat.llm.bpe_queries import op2_bpe_round_trip, vocabulary
from bookheat.llm.common import table

SF = "/root/testdata/sf0.01"
BITS = ["a", "b", "'", "'s", "'ll", "l", " ", "  ", "\n", "\t", "=", "!", "1", "23", "é", "ß", "漢", "字", "😀", "́", "\x85", " ",
        " ", "<|endoftext|>", "<|endo", "text|>", "the", " the", "ation", "Ω", "٣", "‍"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def hostile(n):
    rng = random.Random(5)
    for _ in range(n):
        some = rng.sample(BITS, rng.choice([1, 2, 4, len(BITS)]))
        yield "".join(rng.choice(some) for _ in range(rng.randint(1, 400)))


def test_joins_are_exact(library):
    c = Codec(vocabulary())
    for text in hostile(800):
        for most in (3, 7, 40):
            parts = c.leaves(text, most)
            ids = c.join_all([c.encode(p) for p in parts], [p.encode() for p in parts])
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, (text, most)


def test_every_character_is_cut_as_by_the_library(library):
    c = Codec(vocabulary())
    chars = [chr(x) for x in range(0x20000) if not 0xD800 <= x < 0xE000]
    for at in range(0, len(chars), 512):
        text = "".join(f"a{x}1{x} {x}{x}!{x}'s" for x in chars[at : at + 512])
        assert c.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, at


def test_cases(spark, library):
    long = "x" * 5000 + " y" * 3000 + "<|endoftext|>" * 300 + " " * 4000 + "é" * 3001
    rows = [(1, None, "u"), (None, "", "v"), (2, long, "w"), (2, long, "w"), (3, "hello world", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode(encode(docs, vocabulary(), leaf_chars=100), vocabulary()).collect()
    assert len(got) == 5
    want = {(i, t or "") for i, t, _ in rows}
    assert {(r.doc_id, r.decoded) for r in got} == want
    for r in got:
        assert unpack(r.ids).tolist() == library.encode(r.decoded, add_special_tokens=False).ids
    assert encode(docs.limit(0), vocabulary()).count() == 0


def test_query(spark, library):
    got = {r.doc_id: r for r in op2_bpe_round_trip(spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        out = library.decode(ids, skip_special_tokens=False)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(out.encode()).hexdigest()
