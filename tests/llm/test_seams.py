"""Where texts are cut before a tokenizer sees them: alike alone and in place, and few distinct pieces."""

import json
import random
import sys
import unicodedata

import numpy as np
import pytest

from loomline.llm import packing, swap_packing
from loomline.llm._words import seams

OPS = [(swap_packing, "byte_bpe_50k.json"), (packing, "word_bpe_49k.json")]
SIGNS = [*" \n\t.,!'’-_<%|aB9é×÷İßǅŉñ²ªµ你。가̸́́\x0b\x0c\x1c\x7f   　᠎​﻿👍", "  ", "\r\n", "'s", "'S", "'t", "''", "'ll", "word", "été", "Wort", "12", "?!", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext"]


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.concatenate([[0], np.cumsum([len(r) for r in raw])]), np.frombuffer(b"".join(raw), np.uint8)


def same(op, file, texts):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(file)
    ids, n = op.token_ids(file, *flat(texts))
    ends = np.cumsum(n)
    for t, a, b in zip(texts, ends - n, ends, strict=True):
        assert ids[a:b].tolist() == other.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("op", "name"), OPS)
def test_pieces_encode_alone_as_in_place(op, name):
    rng = random.Random(5)
    pairs = [a + b + c for a in SIGNS for b in SIGNS for c in ("", "x", " ")]
    same(op, path(name), pairs + ["".join(rng.choice(SIGNS) for _ in range(rng.randint(1, 40))) for _ in range(4000)])


@pytest.mark.parametrize(("op", "name"), OPS)
def test_a_word_is_asked_for_once_whatever_sign_stands_by_it(op, name, monkeypatch):
    import tokenizers

    asked = []

    class Counting:
        def __init__(self, model):
            self.model = model

        @staticmethod
        def from_file(file):
            return Counting(real.from_file(file))

        def encode_batch_fast(self, parts, **options):
            asked.extend(parts)
            return self.model.encode_batch_fast(parts, **options)

    real = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    monkeypatch.setattr(packing, "_tokenizers", {})
    words, signs = [f"mot{a}é{b}" for a in "abcdefgh" for b in ("", "ü", "n")], ["", ".", ",", "!!", "%%%", "7", "\n"]
    op.token_ids(path(name), *flat([" ".join(w + s for w in words) for s in signs]))
    assert len(asked) <= 2 * len(words) + 2 * len(signs), len(asked)  # with a space before, at the start without; every sign alone


def test_only_letters_count_as_letters_and_no_white_space_as_solid():
    chars = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000]
    last = np.cumsum([len(c.encode()) + 1 for c in chars]) - 1
    sign, space = (seams(np.frombuffer("".join(c + s for c in chars).encode(), np.uint8), [])[last] for s in "! ")
    for c, before_sign, before_space in zip(chars, sign.tolist(), space.tolist(), strict=True):
        letter = 0xC0 <= ord(c) < 0x280 and c not in "×÷İ"
        assert before_sign == letter and (not letter or all(unicodedata.category(x)[0] == "L" for x in c + c.lower())), c
        assert not (before_space and c.isspace()), c


@pytest.mark.parametrize(("op", "name"), OPS)
def test_a_tokenizer_that_splits_otherwise_is_not_cut_at_seams(op, name, tmp_path):
    """One that takes a sign together with the word behind it."""
    with open(path(name), encoding="utf-8") as f:
        model = json.load(f)
    model["pre_tokenizer"] = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"[^\s\p{L}\p{N}]?\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+" + r"|\s+(?!\S)|\s+" * (op is swap_packing)}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }
    file = str(tmp_path / name)
    with open(file, "w", encoding="utf-8") as f:
        json.dump(model, f)
    assert packing.by_kind(file) is None and packing.by_kind(path(name)) is not None
    texts = ["a .word and (more) x", "one-two 3.four", "(the) .the .the"]
    same(op, file, texts)
