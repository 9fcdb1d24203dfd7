"""Spans of bytes are told apart: hashes without algebraic patterns, and memos that compare bytes."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waypath.llm import common, lookup, tokens


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n)), "".join("ba"[bin(i).count("1") % 2] for i in range(n))


def spans(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    return data, ends - [len(t) for t in texts], ends


@pytest.mark.parametrize("n", [64, 512, 1024, 2048, 1 << 17])
def test_mirror_images_differ(n):
    a, b = thue_morse(n)
    h = common.span_hashes(*spans([a.encode(), b.encode(), a.encode()]))
    assert h[0] != h[1] and h[0] == h[2]


def test_counts_of_mirror_images():
    from tokenizers import Tokenizer

    own, texts = Tokenizer.from_file(tokens.default_tokenizer()), [x for n in (1024, 2048, 4096) for x in thue_morse(n)]
    ids, at = tokens.Encoder(tokens.default_tokenizer())(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == own.encode(t, add_special_tokens=False).ids


@given(st.lists(st.binary(max_size=700), min_size=1, max_size=30), st.integers(1, 900))
@settings(max_examples=60, deadline=None)
def test_blocks_and_gaps_change_no_hash(texts, block):
    gap = b"".join(b"  " + t for t in texts) + b" "
    starts = np.cumsum([2 + len(t) for t in texts]) - [len(t) for t in texts]
    ends = starts + [len(t) for t in texts]
    want = [int(common.span_hashes(*spans([t]))[0]) for t in texts]
    old = common.CHUNK_BYTES
    try:
        common.CHUNK_BYTES = block
        assert common.span_hashes(np.frombuffer(gap, np.uint8), starts, ends).tolist() == want
    finally:
        common.CHUNK_BYTES = old
    assert len(set(want)) == len(set(texts))


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_memo_with_equal_hashes(monkeypatch, bits):
    """With a hash of few bits nearly all words collide, and are still told apart."""
    own = common.span_hashes
    monkeypatch.setattr(lookup, "span_hashes", lambda *a: own(*a) & np.uint64(2**bits - 1))
    rng = np.random.default_rng(4)
    seen: list[bytes] = []
    memo = lookup.Memo()
    table = lookup.WordTable(lambda words: [len(w) * 1000 + sum(w.encode()) for w in words], most=40)
    for _ in range(12):
        texts = [bytes(rng.integers(97, 100, rng.integers(0, 5)).astype(np.uint8)) for _ in range(60)]
        number, new = memo(*spans(texts))
        seen += new
        assert [seen[i] for i in number] == texts and len(set(seen)) == len(seen)
        assert table(*spans(texts)).tolist() == [len(t) * 1000 + sum(t) for t in texts]
