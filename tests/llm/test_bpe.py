import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from fieldweave.llm.bpe import Bpe

from .docs import ODD


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    return Bpe.of(path), plain


def test_ids_equal_the_tokenizers_library(both):
    bpe, plain = both
    rnd = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "é", "A", "1", "²", "!", "…", "“", " ", "　", "中", "😀", "͸", "\x85", "\x1c", "​", "٣", "<|endoftext|>", "it's", "''s"]
    for _ in range(1500):
        docs = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3)]
        ids, bounds = bpe.block(docs)
        for k, doc in enumerate(docs):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(doc, add_special_tokens=False).ids, repr(doc)


def test_blocks_hold_whole_documents(both):
    bpe, plain = both
    docs = [t for _, t in ODD]
    got = {}
    for first, ids, bounds in bpe.ids(docs, block_chars=100):
        for k in range(len(bounds) - 1):
            got[first + k] = ids[bounds[k] : bounds[k + 1]].tolist()
    assert got == {k: plain.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(docs)}


def test_cache_is_cleared_when_full(both, monkeypatch):
    bpe, plain = both
    monkeypatch.setattr("fieldweave.llm.bpe._MAX_IDS", 10)
    for doc in ("alpha beta gamma", "delta epsilon zeta", "alpha zeta"):
        ids, _ = bpe.block([doc])
        assert ids.tolist() == plain.encode(doc, add_special_tokens=False).ids


def test_added_tokens_as_the_library_has_them_by_default():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, bpe = Tokenizer.from_file(path), Bpe.of(path, True)
    rnd = random.Random(3)
    parts = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "hi", "'s", "é", "日"]
    docs = ["<|endoftext|> hi", "<|endoftext|>", "", "a  <|endoftext|><|endoftext|>  b"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(500)]
    ids, bounds = bpe.block(docs)
    for k, doc in enumerate(docs):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(doc, add_special_tokens=False).ids, repr(doc)
    assert bpe.block(docs[:1])[0].tolist()[0] == 50256
