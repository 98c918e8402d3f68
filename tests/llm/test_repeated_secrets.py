"""A secret is as costly to guess where a document repeats it."""

from weblens.llm.secrets import base_spans, guess_spans


def found(text):
    return [text[a:b] for _, a, b in guess_spans(text, base_spans(text))]


def test_repeated_secret():
    value = "xkqvzjwpbtmrhd"
    line = f"passphrase: {value}\n"
    assert found(line) == [value]
    assert found(f"some text\n{line}more text\n{line}{line}") == [value] * 3
    assert found(f"pwd: {value}7\nlogin: {value}7\n") == [value + "7"] * 2
    assert found(f"password={value}\npassword={value}\npassphrase: {value}\n") == [value]  # the first two are base spans


def test_words_of_the_text_are_known():
    assert found("the breadwinner of the house. login: breadwinner") == []
    assert found("login: breadwinner, the breadwinner of the house; login: breadwinner") == []
