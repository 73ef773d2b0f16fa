import random
import zlib

import numpy as np
import pytest

from noveltybench.llm import language


def naive(sample, text):
    """Phrases of ``text`` by looking for each longest match in the sample."""
    phrases, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        phrases, at = phrases + 1, at + n
    return phrases


@pytest.mark.parametrize(("cells", "lanes"), [(1 << 22, 128), (1 << 22, 4), (0, 4)])
def test_phrases_equal_naive_longest_matches(monkeypatch, cells, lanes):
    """Flat and searched tables, in step and one by one, on texts of up to 3,000 characters."""
    monkeypatch.setattr(language, "FLAT_CELLS", cells)
    monkeypatch.setattr(language, "LANES", lanes)
    rnd = random.Random(2)
    sample = "".join(rnd.choice("abcd ") for _ in range(2500)).replace("  ", " a")
    model = language.Model((("xx", sample), ("yy", "zzz zz")))
    known = "".join(map(chr, language.normalise([sample])[0]))
    texts = ["".join(rnd.choice("abcde ") for _ in range(rnd.choice([0, 1, 7, 200, 3000]))) for _ in range(30)] + [sample, sample[300:2000] + sample[100:900], "For " * 700]
    phrases, lengths = model.phrases(texts)
    for text, got, n in zip(texts, phrases[:, 0].tolist(), lengths.tolist(), strict=True):
        seen = "".join(map(chr, language.normalise([text])[0]))
        assert (n, got) == (len(seen), naive(known, seen))
    assert phrases[30, 0] == 1  # a text that occurs whole in the sample


def test_large_alphabets_take_little_memory():
    rnd = random.Random(3)
    sample = "".join(chr(0x4E00 + rnd.randrange(4000)) for _ in range(24_000))
    (own, parser) = language.Model((("zh", sample),)).parsers[0]
    assert parser.flat is None and parser.keys.nbytes + parser.targets.nbytes < 20_000_000
    codes = language.Model((("zh", sample),)).code_of[np.frombuffer(sample[100:400].encode("utf-32-le"), np.uint32)]
    assert parser.phrases(own[codes], np.array([0, 300])).tolist() == [1]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(odd_docs, no_docs):
    got = language.digest(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(by[d] == "und" for d in (2, 3, 4, 5))
    assert language.digest(no_docs).collect() == []
    assert language.keep_identified(odd_docs).columns == odd_docs.columns


def test_other_scripts_are_rejected(spark):
    rows = [(i, "the cat and the dog went to the house with the tree and the lake " * 8, "en") for i in range(8)] + [(9, "漢字仮名交じり文は日本語の文章であり英語ではない" * 4, None)]
    kept = language.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(8))


def test_short_texts_and_large_alphabets_stay(spark):
    rnd = random.Random(6)
    rows = [(i, "the cat and the dog went to the house with the tree and the lake " * 8, "en") for i in range(8)]
    rows += [(i, "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(400)), "zh") for i in range(10, 16)]
    rows += [(20, "ok", None), (21, "a", None), (22, "xylem", None), (23, "quartz", None)]
    kept = language.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"] for r in kept} == {r[0] for r in rows}
    assert all(r["lang"] == ("en" if r["doc_id"] < 9 else "zh") for r in kept if r["doc_id"] < 20) and all(r["lang"] for r in kept)


def test_fewer_rows_than_the_bound_are_all_learned(spark):
    rows = [(i, f"word{chr(97 + i)} " * 60, "en") for i in range(20)]
    ((name, text),) = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert name == "en" and len(text.split("\0")) == 20
