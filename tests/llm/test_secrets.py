import hashlib
import math
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from weblens.llm.secrets import base_spans, guess_cost, guess_spans, scan_secrets

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    out = [("assign", *m.span()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return out


CASES = [
    "", "password=abc", "PassWord: 'hunter22'", "api_key = \"A1b2C3d4\" apikey:zzzzzz", "token=" + "ab12" * 10, "AKIA" + "A1" * 7, "AKIA" + "A1" * 8,
    "secret=token: abcdefg", "password=token=abcdef", "é" * 5 + " passwd=ünïcode123456", "deadbeef" * 3 + "x" + "deadbeef" * 2, "ſecret=abcdefgh",
]


def test_base_spans():
    for text in CASES:
        assert sorted(base_spans(text)) == sorted(brute(text)), text


def test_costs():
    assert guess_cost("password123") < 6
    assert guess_cost("qwertyuiop") < 6 and guess_cost("zxcvbnm,./") < 6
    assert guess_cost("aaaaaaaaaaaa") < 4 and guess_cost("abcabcabcabc") < 6
    assert guess_cost("1987-11-23") < 6 and guess_cost("P4ssw0rd!") < 6
    assert guess_cost("abcdefgh") < 5 and guess_cost("87654321") < 5
    assert guess_cost("xK9#mQ2$vL5@nR8") > 18
    assert guess_cost("correcthorsebatterystaple") < 10


def test_cost_is_the_cheapest_segmentation():
    from weblens.llm import secrets as s

    def slow(value):
        pieces = s._matches(value, frozenset())
        best = {0: 0.0}
        for j in range(1, len(value) + 1):
            options = [best[j - 1] + s._size(value[j - 1])]
            options += [best[i] + c + (0.3 if i else 0.0) for i, e, c in pieces if e == j]
            best[j] = min(options)
        return best[len(value)]

    for value in ("admin2020xyz", "tigerTIGER19", "q1w2e3r4", "letmein!!", "a", ""):
        assert abs(slow(value) - guess_cost(value)) < 1e-9


def slow_lines(value, s):
    """Runs and walks from each place to where they break, one step at a time."""
    out, low = [], value.lower()
    keys = [s.SHIFTED.get(c, c) for c in low]
    for i in range(len(low) - 1):
        for walk in (False, True):
            j, turns, step = i + 1, 0, None
            while j < len(low):
                line = keys if walk else low
                now = ord(line[j]) - ord(line[j - 1])
                if walk and keys[j] not in s._NEXT.get(keys[j - 1], ()):
                    break
                if not walk and (abs(now) != 1 or step not in (None, now)):
                    break
                turns += walk and step is not None and now * step < 0
                step, j = now, j + 1
            if j - i >= 3 + walk:
                out.append((i, j, (1.7 if walk else 1.3) + math.log10(j - i) + 0.6 * turns))
    return out


@given(st.text(alphabet="qwertyasdf123abcdedcba!@#Q", max_size=30))
@settings(max_examples=300, deadline=None)
def test_walks_and_runs(value):
    from weblens.llm import secrets as s

    got = [m for m in s._matches(value, frozenset())]
    for want in slow_lines(value, s):
        assert any(m[:2] == want[:2] and abs(m[2] - want[2]) < 1e-9 for m in got), want


def test_added_spans_against_all_segmentations():
    from weblens.llm import secrets as s

    def cheapest(value):
        pieces = {}
        for i, j, c in s._matches(value, frozenset()):
            pieces[i, j] = min(c, pieces.get((i, j), 99.0))
        for i, c in enumerate(value):
            pieces[i, i + 1] = min(s._size(c), pieces.get((i, i + 1), 99.0))

        def from_(i):
            rest = [c + from_(j) + (0.3 if a and j - a > 1 else 0.0) for (a, j), c in pieces.items() if a == i]
            return min(rest) if i < len(value) else 0.0

        return from_(0)

    for value in ("xK9#mQ2$vL5", "letmein!", "aaaaaa11", "qwertzuiop", "Zk9#mQ2$", "hunter2019", "pqrstuvw"):
        text = f"login: {value}"
        assert bool(guess_spans(text, base_spans(text))) == (cheapest(value) >= s.LEAST_COST), value


def test_a_value_that_a_base_span_cuts_into():
    text = 'password="abc123!Zk9#mQ2$vL5@nR8", password=plainvalue1234567'
    assert base_spans(text)[0] == ("assign", 0, 16)
    assert [text[a:b] for _, a, b in guess_spans(text, base_spans(text))] == ["abc123!Zk9#mQ2$vL5@nR8"]


def test_very_long_values():
    began = time.time()
    for value in ("q1" * 100_000, "x7#K" * 50_000, "abcdefghijklmnopqrstuvwxyz" * 8_000, "a" * 200_000, "passw0rd" * 25_000):
        guess_spans(f"login: {value}", [])
    guess_spans("login: x7K#pp9qR " * 60_000, base_spans("token=abcdef123 " * 60_000))
    assert time.time() - began < 40


def test_guesses():
    text = "db_pwd: xK9#mQ2$vL5nR8, pin=000000, Authorization: Bearer zT7qLw93kXb2Vn5R, passphrase = password123"
    found = [text[a:b] for _, a, b in guess_spans(text, base_spans(text))]
    assert found == ["xK9#mQ2$vL5nR8", "zT7qLw93kXb2Vn5R"]
    assert guess_spans("the key is in the door, see: page", []) == []


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(99, None, "y"), (None, "token=abcdef", "z"), (1, CASES[1], "x")]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    order = {"assign": 0, "access": 1, "hex": 2}
    want = {}
    for i, t, _ in rows:
        spans = sorted(brute(t or ""), key=lambda s: (s[1], order[s[0]]))
        want[i] = (hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), len([s for s in spans if s[0] == "hex"]))
    assert all((r["base_sha256"], r["n_hex"]) == want[r["doc_id"]] for r in got)
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []
