"""The chunks of a task of usual size are learned once, and odd chunks have the library's ids."""

import numpy as np

from skerry.llm import packing
from skerry.llm.common import TokenBytes


def test_chunks_of_a_task_are_learned_once(monkeypatch):
    tokens = TokenBytes(packing.word_bpe())
    learned = []
    monkeypatch.setattr(TokenBytes, "_learn", lambda self, new: (learned.append(len(new)), self.chunks.update(dict.fromkeys(new, b"1234"))))
    texts = [" ".join(f"w{k}" for k in range(a, a + 50_000)) for a in range(0, 500_000, 50_000)]
    for _ in range(2):
        for text in texts:
            assert len(tokens.encode([text])[0]) == 4 * 50_000
    assert sum(learned) == 500_000


def test_odd_chunks_have_the_same_ids():
    tokens = TokenBytes(packing.word_bpe())
    texts = ["ª µ º İ ß ẞ Ünï don't We'LL ﬁ <|endoftext|> a<|b a1b2 é é 日本 \x1c x\x1dy", "", "  \n", "ABC abc Abc", "퟿ 🙂🙂 a b ǅ ʼn"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode(texts)] == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
