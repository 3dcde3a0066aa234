"""Texts cut into units: what both tokenizers make of the units is what they make of the whole text."""

import random

import pyarrow as pa
import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st

from jarledger.llm import token_output, units

with open(token_output.MODEL, encoding="utf-8") as f:
    TOKENS = token_output.Tokens(f.read())
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ALPHABET = [*"ab cZ09 .,;:!?|$%&*#'_-/\n\t\r\x1c\x00", *map(chr, (0x85, 0xA0, 0x2003, 0x2028, 0x3000)),
            "é", "×", "÷", "ß", "ł", "Ж", "я", "語", "🦜", "’s", "'s", " the", " ,", "…"]


def test_units_join_to_the_texts():
    texts = pa.array(["a b\nc, d  e", None, "", " x\n", "é. ß, …, ×."])
    found = units.Units(texts)
    at = found.text_starts.tolist()
    assert [b"".join(found.distinct[c] for c in found.codes[a:b]).decode() for a, b in zip(at, at[1:])] == [t or "" for t in texts.to_pylist()]
    assert {"a", " b", "c", ",", "\n", "é", ".", " ß", " …,"} <= {u.decode() for u in found.distinct}
    assert units.Units(pa.array([], pa.string())).distinct == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
def test_unit_ids_equal_whole_ids(text):
    assert np.frombuffer(TOKENS.encode(text), TOKENS.type).tolist() == TOKENS.model.encode(text, add_special_tokens=False).ids


def test_unit_ids_of_documents(spark, texts):
    some = [t for t in texts.values()] + ["".join(random.Random(k).choices(ALPHABET, k=300)) for k in range(50)]
    ids, at = TOKENS.encode_texts(pa.array(some))
    for text, a, b in zip(some, at.tolist(), at.tolist()[1:]):
        assert ids[a:b].tolist() == TOKENS.model.encode(text, add_special_tokens=False).ids


def test_cuts_hold_for_the_piece_vocabulary():
    pieces = [PIECES.id_to_piece(i).replace("▁", " ") for i in range(PIECES.vocab_size())]
    assert units.crosses_nothing(pieces)
    assert not any(units.crosses_nothing([p]) for p in ("a.", "a b", "a\n", "\na"))
