"""Languages with more letters than fit one narrow table."""

import numpy as np

from octofold.llm import language_id


def words(rng, first, n, count):
    return " ".join("".join(chr(first + i) for i in rng.randint(0, n, 3)) for _ in range(count))


def test_scripts_with_many_letters():
    rng = np.random.RandomState(2)
    scripts = {"am": (0x1200, 70), "en": (0x61, 26), "ja": (0x3042, 80), "ko": (0xAC00, 400), "ru": (0x430, 32), "vai": (0xA500, 260), "zh": (0x4E00, 400)}
    m = language_id.Model({k: [words(rng, *v, 2000)] for k, v in scripts.items()})
    texts = [words(rng, *scripts[k], 30) for k in scripts]
    lang, score = m.predict(texts)
    assert lang == list(scripts) and min(score) > 0.9


def test_phrases_with_rare_symbols():
    rng = np.random.RandomState(3)
    ref = words(rng, 0x4E00, 300, 400)
    m = language_id.Model({"zh": [ref], "x": ["zzz qqq"]})
    assert len(m.rare_keys)
    whole = m.symbol[language_id.code_units(ref)].tolist()
    have = {tuple(whole[i:j]) for i in range(len(whole)) for j in range(i + 1, min(len(whole), i + 40) + 1)}
    for text in (ref[100:130] + ref[40:60], words(rng, 0x4E00, 320, 60), "abc " + ref[:9]):
        symbols = m.symbol[language_id.code_units(text)].tolist()
        n, i = 0, 0
        while i < len(symbols):
            j = i + 1
            while j < len(symbols) and tuple(symbols[i : j + 1]) in have:
                j += 1
            n, i = n + 1, j
        assert m.phrases([text])[0, m.languages.index("zh")] == n
