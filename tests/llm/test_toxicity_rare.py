"""Toxic words of a language with few of the labelled rows get weights."""

import numpy as np

from skerry.llm import toxicity


def test_words_of_a_small_language_get_weights():
    rng = np.random.default_rng(1)
    large, small = [f"word{chr(97 + k)}" for k in range(20)], [f"wort{chr(97 + k)}" for k in range(20)]
    texts, labels = [], []
    for k in range(2000):
        rare, toxic = k % 50 == 0, k % 10 == 0 if k % 50 else k % 100 == 0
        words = set(rng.choice(small if rare else large, 6))
        if toxic:
            words.add(f"schlimm{chr(97 + k // 100 % 5)}" if rare else "awful")
        texts.append(words)
        labels.append(float(toxic))
    model = toxicity.fit_words(texts, np.array(labels))
    clear = model.score("worta wortb wortc")
    for k in range(5):  # four texts in two thousand hold each
        word = f"schlimm{chr(97 + k)}"
        assert model.weights.get(word, 0) > 0 and model.score(f"worta wortb {word}") > clear
