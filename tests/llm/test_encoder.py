"""Pieces are encoded many at a time, on one thread, with the ids of the library."""

import os

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer, models, pre_tokenizers

from waypath.llm import tokens


def same(encode, own, texts):
    ids, at = encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [own.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_the_library_gets_many_pieces_as_one_text(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    path = tokens.default_tokenizer()
    encode, given_texts = tokens.Encoder(path), []
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    all_of = encode.encode_all
    encode.encode_all = lambda texts: given_texts.extend(texts) or all_of(texts)
    texts = [" ".join(f"wörd{i * j}x" for j in range(1, 400)) for i in range(1, 6)]
    same(encode, Tokenizer.from_file(path), texts)
    pieces = encode.memo.size
    assert pieces > 1000 and len(given_texts) <= pieces / tokens.JOINED_PIECES + 6


@given(st.lists(st.lists(st.text(st.sampled_from("ab é\u00a0\u3000\n\t'1-😀"), max_size=12) | st.sampled_from(["  ", " <|endoftext|>", "<|endoftext|> x"]), max_size=6).map("".join) | st.none(), max_size=8))
@settings(max_examples=200, deadline=None)
def test_odd_blanks_give_the_ids_of_the_library(texts):
    path = tokens.default_tokenizer()
    encode = tokens.kept(("test", path), lambda: (tokens.Encoder(path), Tokenizer.from_file(path)))
    same(*encode, texts)


def test_a_vocabulary_with_tokens_of_two_blanks(tmp_path):
    """The second of two blanks before another text, or before an added token, starts no piece of its own."""
    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    own = Tokenizer(models.BPE({t: i for i, t in enumerate([*letters, "ĠĠ"])}, [("Ġ", "Ġ")]))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    own.add_special_tokens([AddedToken("<|end|>", special=True, normalized=False)])
    own.save(f"{tmp_path}/two.json")
    same(tokens.Encoder(f"{tmp_path}/two.json"), own, ["x  ", "abc", "a  <|end|>b", "c   d", None])
