import re
import zlib

import corpus_pipeline
from tokenizers import Tokenizer

from weblens.llm.decontaminate import plain_words
from weblens.llm.mixing import mix
from weblens.llm.quality import train_quality
from weblens.llm.token_output import default_tokenizer


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf).cache()
        seen[name] = (before, docs)
        assert docs.count() > 0
        assert name == "tokens" or docs.columns == columns
    texts = {k: {r["doc_id"]: r["text"] for r in b.collect()} for k, (b, _) in seen.items()}
    ids = lambda k: {r["doc_id"] for r in seen[k][1].select("doc_id").collect()}

    model = train_quality(seen["quality"][0], spark.read.parquet(f"{sf}/labels.parquet"))
    keys = list(texts["quality"])
    scores = dict(zip(keys, model.scores([texts["quality"][k] for k in keys]), strict=True))
    assert ids("quality") == {k for k, s in scores.items() if s >= 0.5}

    def shingles(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()

    own = {k: shingles(re.findall(r"[^\x20\x09-\x0D]+", t.lower())) for k, t in texts["near_duplicates"].items()}
    least = dict.fromkeys(own)
    for k in sorted(own):
        least[k] = k
    changed = True
    while changed:
        changed = False
        for a in own:
            for b in own:
                if a < b and least[a] != least[b] and own[a] and own[b]:
                    both = len(own[a] & own[b])
                    if 100 * both >= corpus_pipeline.NEAR_PERCENT * len(own[a] | own[b]):
                        least[a] = least[b] = min(least[a], least[b])
                        changed = True
    assert ids("near_duplicates") == {k for k, c in least.items() if k == c}

    items = [shingles(plain_words(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = set()
    for k, t in texts["decontamination"].items():
        have = shingles(plain_words(t))
        if not any(i and len(i & have) >= 0.8 * len(i) for i in items):
            kept.add(k)
    assert ids("decontamination") == kept

    taken = {r["doc_id"]: r["taken"] for r in mix(seen["mixing"][0]).collect()}
    assert {k: len(t.split()) for k, t in texts["tokens"].items()} == {k: n for k, n in taken.items() if n}

    tokenizer = Tokenizer.from_file(default_tokenizer())
    at = 0
    rows = {r["doc_id"]: r for r in seen["tokens"][1].collect()}
    for k in sorted(texts["tokens"]):
        got = tokenizer.encode(texts["tokens"][k], add_special_tokens=False).ids + [0]
        assert (rows[k]["start"], rows[k]["n_tokens"]) == (at, len(got))
        assert rows[k]["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in got))
        at += len(got)
    assert corpus_pipeline.run(spark, sf).count() == len(rows)


def test_any_table(spark, sf):
    rows = [(1, None, None, None, None), (None, "some words here", "en", "s", 15), (2, "", "en", "s", 0), (2, "x y z", None, None, 5), (2, "x y z", None, None, 5)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, held_out int"
    for table in ([(*r, 1) for r in rows], []):
        docs = spark.createDataFrame(table, kind)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            assert name == "tokens" or docs.columns == [c.split(" ")[0] for c in kind.split(", ")]
        docs.collect()
