"""Texts are taken apart into pre-tokens before any is looked up or encoded."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tallyfold.llm import token_store
from tallyfold.llm.queries import tokenizer_path

from .test_contracts import plain_ids

WORDS = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}é" for k in range(100)]
MARKS = [f"{m}{n}" for m in ",.;:!?#*" for n in ",.;:!?#*"]


def test_each_word_and_mark_is_looked_up_once():
    """Before, each of the 6,400 pairs was a piece to look up, encode and keep."""
    encoder = token_store.Encoder(tokenizer_path())
    rows = [" ".join(w + m for w in WORDS) for m in MARKS]
    ids, counts = encoder.encode(pa.array(rows))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [list(x)[:-1] for x in plain_ids(rows)]
    assert len(encoder.known) == len(WORDS) + len(MARKS)


SIGNS = [
    "a", "word", "é", "ß", "Ö", "ø", "×", "÷", "ɏ", "ɐ", "ʯ", "1", "23", "²", "٣", ",", "...", "!", "'", "'s", "don't", "’",
    "<|endoftext|>", "<|", "|>", "\n", "\n\n", "\r\n", "\t", "\x00", "\x0b", "\x1f", "\x85", "\xa0", "　", " ", "​", "漢", "я", "é", "😀",
]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_cuts_are_those_of_the_library(kind):
    drawn = random.Random(3)
    rows = ["", " ", "\n", "", *("".join(drawn.choices(SIGNS + [" "] * drawn.choice([0, 8, 40]), k=drawn.randint(0, 20))) for _ in range(20_000)), ""]
    rows += [f"{a}{s}{b}{t}{c}" for a in SIGNS for b in SIGNS for c in ("a", ",", "\n", "") for s in ("", " ") for t in ("", " ")]
    encoder = token_store.Encoder(tokenizer_path())
    ids, counts = encoder.encode(pa.array(["not in it", *rows], kind).slice(1))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [list(x)[:-1] for x in plain_ids(rows)]


def test_no_texts():
    ids, counts = token_store.Encoder(tokenizer_path()).encode(pa.array([], pa.string()))
    assert len(ids) == len(counts) == 0
