"""New units enter the cache together, and odd characters among them become their bytes."""

import numpy as np
import public_tokenizers
import sentencepiece

from sievework.llm import piece_lattice, token_store
from sievework.llm.common import UnitCache


def test_many_units_are_added_at_once():
    cache = UnitCache(lambda c, new: c.extend(new, np.concatenate([[len(u)] * len(u) for u in new]), [len(u) for u in new]))
    words = ["w" * (k % 40) + str(k) for k in range(9000)]
    for texts in ([words[:10], []], [words, words[5:7]]):
        ids, n = cache.encode(texts)
        assert ids.tolist() == [len(u) for t in texts for u in t for _ in u]
        assert n.tolist() == [sum(map(len, t)) for t in texts]


def test_units_of_a_group_with_unknown_characters_between_others():
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    words = ["a", "\U0001f9ff", "house\U0001f9ffé", "͸", "b͸͸c", "water", "x" * 70000, "wörter"]
    ids, n = piece_lattice.PieceModel(path).encode_units([piece_lattice.SPACE + w for w in words])
    cut = np.r_[0, np.cumsum(n)]
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [library.encode(w) for w in words]


def test_words_of_one_input_have_the_ids_of_whole_texts():
    tokens = token_store.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["a <|endoftext|>b c<|startoftext|> <| x", "ΟΔΟΣ Σ Σ. ́a e ́ é", "it's ' 's don't\r\x0b1234 ¾ 　z", "",
             "​ ﻿ \x00 가 ᄀ ᅡ 🧿👩‍👩‍👧", "<|endoftext|> <|endoftext|><|endoftext|>", "  \n\t "]
    ids, n = tokens.encode(texts)
    cut = np.r_[0, np.cumsum(n)]
    whole = [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == whole
