import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from revlake.llm import bpe

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = bpe.Coder(*bpe._vocabulary(None))


def library(text):
    return np.array(ENC.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab theingons'  \n\t\r\x1c\x0b 　éß漢🙂0³Ⅷ._!?|<>ZQ"), max_size=40), max_size=4))
def test_ids_are_the_librarys_and_decode(texts):
    got = CODER.encode(texts)
    assert got == [library(t) for t in texts]
    assert CODER.decode(got) == [t.encode() for t in texts]


def test_long_pieces():
    rng = random.Random(3)
    words = ["a" * 2000, "".join(rng.choices("theingan", k=3000)), "=" * 700, "".join(rng.choices("éàüñ", k=900)), "x" * 513, "y" * 512]
    assert CODER.encode(words) == [library(w) for w in words]
    assert [CODER.merge_long(w.encode()) for w in words[:3]] == [library(w) for w in words[:3]]


def test_small_caches_change_nothing(monkeypatch):
    texts = [f"word{i} of {i * 7} and\nmore{i % 3}" for i in range(300)]
    monkeypatch.setattr(bpe, "KEPT_UNITS", 5)
    coder = bpe.Coder(*bpe._vocabulary(None))
    for at in range(0, 300, 50):
        got = coder.encode(texts[at : at + 50])
        assert got == [library(t) for t in texts[at : at + 50]]
        assert coder.decode(got) == [t.encode() for t in texts[at : at + 50]]


def test_frames(make_docs):
    rows = [(1, "Hello  world"), (2, None), (2, ""), (None, "über"), (3, "a b\n\n c " * 900), (1, "Hello  world")]
    docs = make_docs(rows)
    expected = sorted((str(i), len(library(t or "")) // 4, hashlib.sha256(library(t or "")).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs).collect()) == expected
    ids = bpe.encoded(docs, ["doc_id", "size", "__n"])
    assert ids.columns == ["doc_id", "size", "__n", "n_tokens", "ids"]
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in bpe.decoded(ids).collect()) == sorted((str(i), (t or "").encode()) for i, t in rows)
    assert bpe.round_trip(make_docs([])).collect() == [] and bpe.encoded(make_docs([])).collect() == []
