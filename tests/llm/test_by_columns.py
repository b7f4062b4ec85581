"""Encoders that take the words of many texts together, by columns."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from slopeworks.llm import bpe, packing  # noqa: E402


def test_plain_words_never_go_to_the_library_one_by_one():
    """Neither first words nor those beside a line feed; only texts with other white space have their first word encoded alone."""
    coder = packing.WordIds(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    alone = []
    whole, coder.encode = coder.encode, lambda text: alone.append(text) or whole(text)
    texts = [f"First{k} of a line.\nÉnd{k}, 'll\n's\n..x" for k in range(300)]
    got = list(coder.of(pa.array(texts)))
    assert alone == []
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole(t).tolist() for t in texts]


@pytest.mark.parametrize("most", [40, 600_000])
def test_packed_ids_are_the_librarys_whatever_is_forgotten(most):
    coder = packing.WordIds(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    coder.most = most
    rnd = random.Random(3)
    odd = [*"aE é ǆɏɐЖ한\U0001f600\x0b\x0c\x1c\x1f\x85\xa0 　​ 'LL12\t\n\n  \n.,!", " b", "\nb", " 'll", "\n's", "\n.", "<|endoftext|>", "c", "d e\nf"]
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(14))) for _ in range(3000)] + [None, "", " ", "\n", "\n\n"]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        assert [np.frombuffer(x, "<u4").tolist() for x in coder.of(pa.array(some, pa.string()))] == [coder.encode(t or "").tolist() for t in some]


@pytest.mark.parametrize("most", [40, 400_000])
def test_word_ids_are_the_librarys_whatever_is_forgotten(most, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    ref, splitter = Tokenizer.from_file(path), bpe.Tokenizer(path)
    bpe.write_lexicon(bpe.compile_lexicon([(w.encode(), splitter.merge(w)) for w in sorted(["a", "aé", "b", "word", "'s", ".", "é"])]), str(tmp_path / "x"))
    coder = bpe.Coder(path, str(tmp_path / "x"))
    coder.most = coder.words.most = most
    rnd = random.Random(5)
    odd = [*"aE éΣ한\U0001f600\x0b\x1c\x1f\x85\xa0\u3000\u0301'1.,! \t\n", " a", " word", "\nB", "'S", "<|endoftext|>", "<|", "ΑΣ Σ"]
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(14))) for _ in range(3000)] + [None, "", " ", "\n \n"]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        ids, decoded = coder.columns(pa.array(some, pa.string()))
        want = [ref.encode(t or "", add_special_tokens=False).ids for t in some]
        assert ids.to_pylist() == want and decoded.to_pylist() == [ref.decode(x, skip_special_tokens=False) for x in want]


def test_known_texts_are_put_together_without_a_call_for_each():
    """Python's work is on chunks not seen before, not on each text or each of its chunks."""
    coder = bpe.Coder(P.path("word_bpe_49k.json"), None)
    calls = []
    coder.chunks = lambda text: calls.append(text) or text.split()
    coder.learn, learn = lambda unseen: calls.append(len(unseen)) or learn(unseen), coder.learn
    texts = [f"a b c{k % 3}\n d" for k in range(500)]
    coder.of(texts)
    coder.of(texts)
    assert calls == [6]
