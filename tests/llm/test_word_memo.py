"""What the encoder of packing keeps: words in use are encoded once, however many others pass, and the ids stay the library's."""

import random
import struct

from tokenizers import Tokenizer

from perfloom.llm import packing
from perfloom.llm.token_counts import tokenizer_path

from .cases import nasty_rows, words


def test_words_in_use_are_made_once():
    made = []
    memo = packing.Memo(lambda k: made.append(k) or k.upper(), 10)
    for i in range(200):
        assert (memo["often"], memo[f"w{i}"]) == ("OFTEN", f"W{i}")
    assert made.count("often") == 1 and len(made) == 201
    assert memo["x" * 65] == "X" * 65 and len(memo) <= 10 and len(memo.old) <= 10 and "x" * 65 not in memo


def test_ids_are_the_librarys_with_a_full_memory(monkeypatch):
    path, rng = tokenizer_path("word_bpe_49k.json"), random.Random(3)
    lib = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "MEMO", 20)
    encode = packing.word_encoder.__wrapped__(path)
    odd = ["It's we'LL ALPHA Beta9 x.y", "<|endoftext|> a<|endoftext|>b endoftext", "Über ſtraße İi é naïve", "KK 日本語テキスト " + "long" * 50, words(rng, 900, "abAB.1é'")]
    for text in [*odd, *(r[1] for r in nasty_rows() if r[1])]:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert encode(text.encode()) == struct.pack(f"<{len(ids)}I", *ids), text[:40]


def test_a_worker_has_one_encoder():
    path = tokenizer_path("word_bpe_49k.json")
    assert packing.word_encoder(path) is packing.word_encoder(path)
