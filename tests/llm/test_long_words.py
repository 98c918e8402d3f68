"""Runs of letters that are longer than what features look at."""

from weblens.llm import langid


def test_all_letters_are_read():
    text = "short " + "".join(chr(0x4E00 + i) for i in range(200)) + " words"
    words = langid.words_of(text)
    assert "".join(words) == text.replace(" ", "") and max(map(len, words)) == langid.WIDTH
    assert langid.words_of("a bc " + "x" * langid.WIDTH) == ["a", "bc", "x" * langid.WIDTH]


def test_long_run_is_judged_by_all_of_it():
    one, two = "กขคงจฉชซฌญ", "ดตถทธนบปผฝ"
    texts = [("".join(s[(i + j * j) % 10] for j in range(20)), k) for k, s in (("one", one), ("two", two)) for i in range(10)]
    tagger = langid.Tagger(langid.fit([(" ".join(t for t, k in texts if k == lang), lang) for lang in ("one", "two") for _ in range(20)]))
    head, tail = "".join(one[i % 10] for i in range(24)), "".join(two[(i * 3) % 10] for i in range(240))
    names, _, switched = tagger.predict([head + tail, head, tail])
    assert names == ["two", "one", "two"] and switched[0] == 1
