import math
import random

import numpy as np
import pytest

from weblens.llm import crf, langid, quality, toxicity


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    k, lengths = 3, np.array([4, 1, 6, 2, 4])
    chain = crf.Chain(np.zeros((1, k)), rng.normal(size=(k, k)), rng.normal(size=k), rng.normal(size=k))
    scores = rng.normal(size=(lengths.sum(), k))
    got, moved, log_z = crf.marginals(scores, lengths, chain, pairs=True)
    want, moves, total, at = np.zeros_like(scores), np.zeros((k, k)), 0.0, 0
    for n in lengths:
        weights = {}
        for code in range(k**n):
            path = [(code // k**i) % k for i in range(n)]
            s = chain.begin[path[0]] + chain.end[path[-1]] + sum(scores[at + i, p] for i, p in enumerate(path))
            s += sum(chain.transitions[a, b] for a, b in zip(path, path[1:], strict=False))
            weights[tuple(path)] = math.exp(s)
        z = sum(weights.values())
        total += math.log(z)
        for path, w in weights.items():
            for i, p in enumerate(path):
                want[at + i, p] += w / z
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += w / z
        at += n
    assert np.allclose(got, want) and np.allclose(moved, moves) and log_z == pytest.approx(total)


def junk(rng, good):
    words = lambda n: [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota".split()) for _ in range(n)]
    lines = []
    for _ in range(rng.randint(1, 8)):
        w = words(rng.randint(5, 30))
        lines.append(" ".join(w).capitalize() + "." if good else " ".join(x + "###" for x in w) if rng.random() < 0.5 else " | ".join([w[0]] * 12))
    return "\n".join(lines)


def test_quality_on_held_out_rows():
    rng = random.Random(1)
    rows = [(junk(rng, y), int(y)) for y in [True, False] * 150]
    model = quality.fit(rows[:200])
    scores = model.scores([t for t, _ in rows[200:]] + ["", "\n\n", "x" * 200_000])
    assert ((scores[:100] >= 0.5) == np.array([y for _, y in rows[200:]])).mean() > 0.97
    assert ((0 <= scores) & (scores <= 1)).all()
    assert quality.fit([]).scores(["anything", ""]).tolist() == pytest.approx([0.5, 0.5], abs=1e-3)


def test_toxicity_folds_and_excepts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(6))
    rows = [(" ".join(word() for _ in range(30)) + (" you moron " if y else " ") + " ".join(word() for _ in range(5)), y) for y in [1, 0] * 80]
    lexicon = toxicity.learn(rows)
    machine = lexicon.automaton()

    def score(text):
        return float(crf.sigmoid(np.append(lexicon.figures(machine, text), 1.0) @ lexicon.calibration))

    assert score("what a moron he is") > 0.7 and score("What a M0R0N!") > 0.7 and score("a mоrоn") > 0.7
    assert score("moronic") < 0.7 or " moron" in lexicon.weights
    assert score("a fine day") < 0.5 and score("") < 0.5
    lexicon.exceptions.append("moron movie")
    assert lexicon.hits(lexicon.automaton(), toxicity.fold("a moron movie")) == {}


TEXTS = {
    "en": "the cat and the dog were there with that other thing when they went to see this house",
    "de": "der hund und die katze sind nicht auf dem haus weil sie nach der arbeit schlafen gehen",
}


def test_language_of_switched_text():
    rng = random.Random(3)
    rows = [(" ".join(rng.sample(TEXTS[k].split(), 8)), k) for k in ["en", "de"] * 60]
    tagger = langid.Tagger(langid.fit(rows))
    names, scores, switched = tagger.predict([TEXTS["en"], TEXTS["de"], "", "123 !", TEXTS["en"] + " " + "der hund und die katze"])
    assert names == ["en", "de", "und", "und", "en"] and scores[2] == 0.0
    assert switched[0] == 0 and switched[4] == 5
    assert all(0 <= s <= 1 for s in scores)
    assert langid.Tagger(langid.fit([])).predict(["abc"])[0] == ["und"]


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "some text\nmore", "z"), (2, "", "y"), (3, "word " * 30_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model, lexicon = quality.fit([("a b c.", 1), ("### ###", 0)]), toxicity.learn([])
    languages = langid.fit([("the house", "en")])
    for out in (quality.score_quality(docs, model), toxicity.score_toxicity(docs, lexicon), langid.detect_language(docs, languages)):
        assert out.count() == len(rows) and out.where("score is null or score < 0 or score > 1").count() == 0
    none = docs.where("doc_id < 0")
    assert quality.score_quality(none, model).count() == toxicity.score_toxicity(none, lexicon).count() == 0
    assert quality.good_documents(docs, model).columns == docs.columns


def test_training_leaves_the_held_out_fold_alone(spark):
    import zlib

    from weblens.llm.common import training_texts

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(300)] + [(None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    got = training_texts(docs, labels, "quality", 100)
    ids = [int(t.split()[1]) for t, _ in got]
    assert len(got) == 100 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids) and all(y == i % 2 for i, (_, y) in zip(ids, got, strict=True))
    assert training_texts(docs, labels, "toxic", 10) == []


def test_numbers_are_no_words_and_long_texts_are_quick():
    import time

    assert toxicity.fold("Highway 455 and 8008, m0r0n b00") == " highway # and # moron boo "
    began = time.time()
    lexicon = toxicity.Lexicon({" moron ": 5.0}, ["moron movie"])
    text = toxicity.fold("moron movie moron " * 100_000)
    assert len(lexicon.hits(lexicon.automaton(), text)) == 100_000
    assert time.time() - began < 20


def test_copies_teach_a_lexicon_once():
    rows = [("strange reheou words of one text", 1)] * 9 + [(f"clean text {chr(97 + i)}", 0) for i in range(9)]
    assert toxicity.learn(rows).weights == {}


def test_a_rare_language_is_learned(spark):
    rows = [(i, TEXTS["en"], "en") for i in range(900)] + [(5000 + i, TEXTS["de"], "de") for i in range(6)] + [(9000, None, "de"), (9001, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train_language(docs, 50)
    assert model.languages == ["de", "en"] and "hund" in model.lexicon
    got = {r["doc_id"]: r["lang_pred"] for r in langid.detect_language(docs, model).collect()}
    assert got[3] == "en" and got[5003] == "de" and got[9000] == "und"


@pytest.mark.parametrize("name, label, least", [("op1_quality", "quality", 0.97), ("op2_toxicity", "toxic", 0.95), ("op4_language", None, 0.97)])
def test_registered_queries_on_held_out_rows(spark, name, label, least):
    from weblens.llm.queries import queries

    folder = "/root/testdata/sf0.01"
    got = queries()[name](spark, folder).where("held_out")
    if label:
        want = spark.read.parquet(f"{folder}/labels.parquet").where(f"{label} is not null").select("doc_id", label)
        both = [r[0] == r[1] for r in got.join(want, "doc_id").select("predicted", label).collect()]
    else:
        want = spark.read.parquet(f"{folder}/documents.parquet").where("lang is not null").select("doc_id", "lang")
        both = [r[0] == r[1] for r in got.join(want, "doc_id").select("lang_pred", "lang").collect()]
    assert len(both) > 100 and np.mean(both) >= least


def test_many_short_lines_take_little_memory():
    import tracemalloc

    model = quality.fit([("a b c.", 1), ("### ###", 0)])
    for texts in (["a\n" * 700] * 200, ["\n" * 140_000]):
        tracemalloc.start()
        scores = model.scores(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(scores) == len(texts) and (scores == scores[0]).all() and peak < 300 * 140_000


def test_quality_does_not_depend_on_blocks(monkeypatch):
    rng = random.Random(4)
    rows = [(junk(rng, y), int(y)) for y in [True, False] * 30]
    texts = [t for t, _ in rows] + ["", "\n\n", "x" * 2000, "one\r\ntwo\x85\nthree \ud800.\n" * 40]
    model = quality.fit(rows)
    want = model.scores(texts)
    own = np.concatenate([quality._bins(quality.block_figures(lines)[0], model.edges) for lines in quality.line_blocks(texts)])
    lengths = quality.line_counts(texts)
    assert len(own) == lengths.sum()
    each = model.chain.weights[quality._features(own, lengths)].sum(axis=1)
    assert np.allclose(quality._line_scores(own, lengths, model.chain.weights), each)
    for name, most in (("LINES", 3), ("CHARS", 50), ("GROUP_LINES", 7)):
        monkeypatch.setattr(quality, name, most)
        assert max(map(len, quality.line_blocks(texts))) <= quality.LINES
        assert np.allclose(model.scores(texts), want, rtol=1e-12) and np.allclose(quality.fit(rows).edges, model.edges)
