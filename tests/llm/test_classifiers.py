import math
import zlib

import numpy as np
import pyarrow as pa

from noveltybench.llm import labelled, language, quality, textops, toxicity

SF = "/root/testdata/sf0.1"


def joined(spark, digest, label):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = digest(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    return [(r[label], r["predicted"]) for r in rows if r["held_out"]]


def test_quality_held_out(spark):
    pairs = joined(spark, quality.digest, "quality")
    assert np.mean([a == b for a, b in pairs]) >= 0.95


def test_toxicity_held_out(spark):
    pairs = joined(spark, toxicity.digest, "toxic")
    toxic = [b for a, b in pairs if a == 1]
    assert np.mean(toxic) >= 0.9 and np.mean([b for a, b in pairs if a == 0]) <= 0.01


def test_bradley_terry_recovers_an_order():
    rng = np.random.default_rng(3)
    truth = np.array([2.0, -1.0, 0.0])
    a, b = rng.normal(size=(4000, 3)), rng.normal(size=(4000, 3))
    wins = rng.random(4000) < 1 / (1 + np.exp(-(a - b) @ truth))
    w = quality.bradley_terry(np.where(wins[:, None], a, b), np.where(wins[:, None], b, a))
    assert np.allclose(w, truth, atol=0.25)


def test_nn_pu_separates_from_unlabelled_rows():
    rng = np.random.default_rng(4)
    positive = (rng.random((300, 6)) < [0.9, 0.8, 0.1, 0.1, 0.1, 0.1]).astype(np.float32)
    hidden = (rng.random((200, 6)) < [0.9, 0.8, 0.1, 0.1, 0.1, 0.1]).astype(np.float32)
    clean = (rng.random((800, 6)) < [0.02, 0.02, 0.1, 0.1, 0.1, 0.1]).astype(np.float32)
    w, b = toxicity.nn_pu(positive, np.vstack([hidden, clean]), 0.2)
    assert np.mean(hidden @ w + b > 0) > 0.85 and np.mean(clean @ w + b > 0) < 0.1


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (7, 1, 0), (4, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.digest(odd_docs, labels).collect()
        assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
        assert module.digest(no_docs, labels).collect() == []
        assert len(module.digest(odd_docs, labels.where("false")).collect()) == odd_docs.count()


def test_long_texts_count_to_their_end(spark):
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i in range(400)], "doc_id long, quality int, toxic int")
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(words[(i * 7 + j) % 5] + str(j % 13) for j in range(60)) + (" vileword grimtoken" if i < 40 else "")) for i in range(400)]
    rows.append((1000, " ".join(words[j % 5] + str(j % 13) for j in range(60_000)) + " vileword grimtoken"))
    rows.append((1001, rows[-1][1].removesuffix(" vileword grimtoken")))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.digest(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert got[1000] == 1 and got[1001] == 0 and sum(got[i] for i in range(40)) >= 38 and sum(got[i] for i in range(40, 400)) == 0


def test_threshold_by_quantile(spark):
    scored = spark.createDataFrame([(i, i / 100) for i in range(100)], "doc_id long, score double")
    assert quality.above_quantile(scored, 0.9).count() in (10, 11)


TEXTS = ["", "One WORD word  Word, and ÉÈ漢 done", "a a a b\x01\t\n B", "x" * 300, "toxic " * 50 + "end"]


def plain_style(text):
    """The style vector, byte by byte."""
    raw = text.encode()
    out = [0.0] * quality.N_FEATURES
    for b in raw:
        out[96 if b < 32 else 97 if b > 127 else b - 32] += 1
    out[:98] = [math.sqrt(c / max(len(raw), 1)) for c in out[:98]]
    words = [w for w in __import__("re").split(rb"[ \t\n\x0b\x0c\r]+", raw) if w]
    low = [w.lower() for w in words]
    n = max(len(words), 1)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / n
    out[98], out[99] = math.log1p(len(raw)) / 10, math.log1p(len(words)) / 10
    out[100], out[101] = mean / 10, math.sqrt(max(sum(x * x for x in sizes) / n - mean * mean, 0)) / 10
    out[102], out[103] = sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, len(set(low)) / n
    out[104], out[105] = sum(sum(65 <= b <= 90 for b in w) > 2 for w in words) / n, float(not raw)
    return out


def test_style_equals_byte_by_byte():
    ((_, _, x),) = quality.style(pa.array(TEXTS))
    assert np.allclose(x, [plain_style(t) for t in TEXTS])


def test_quality_rows_equal_the_model(spark):
    """Scores of the query are the fitted curve over the plain style vectors; predictions cut them at 0.3."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(docs, labels.where(quality.fold("doc_id") != 0))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in quality.digest(docs, labels).collect():
        z = np.clip((np.array(plain_style(texts[r["doc_id"]])) - model.mean) / model.scale, -8, 8)
        want = 1 / (1 + math.exp(-max(-40, min(40, model.slope * float(z @ model.weights) + model.offset))))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3)


def test_toxicity_features_and_scores_equal_plain_ones():
    """A text's features are those of its five-byte runs and its words; a score is the logistic sum of their weights."""
    ((_, _, rows, found),) = toxicity.presence(pa.array(TEXTS))
    for row, text in enumerate(TEXTS):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        grams = {int(toxicity._gram_hashes(np.frombuffer(low[i : i + 5], np.uint8))[0]) for i in range(len(low) - 4)}
        words = set()
        for w in (w for w in __import__("re").split(rb"[ \t\n\x0b\x0c\r]+", low) if w):
            h = toxicity.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
            words.add(int(toxicity.mix(h)[0] >> np.uint64(64 - toxicity.BITS)) | 1)
        assert set(found[rows == row].tolist()) == grams | words
    kept = np.unique(found)
    weights = np.random.default_rng(1).normal(size=len(kept))
    ((_, _, got),) = toxicity.Classifier(kept, weights, -0.5).scores(pa.array(TEXTS))
    for row, s in enumerate(got.tolist()):
        size = len(TEXTS[row].encode())
        f = -0.5 + sum(weights[np.searchsorted(kept, k)] / (1 if k % 2 else math.sqrt(1 + min(size, toxicity.LONG) / toxicity.SHORT)) for k in found[rows == row])
        assert math.isclose(s, 1 / (1 + math.exp(-max(-40, min(40, f)))))


def test_few_rows_are_all_drawn(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(None, 1), (7, None)], "k long, label int")
    got = labelled.spread_ids(rows, "k", "label", 100, 5)
    assert sorted(got) == sorted((i % 3, i) for i in range(300))
    some = labelled.spread_ids(rows, "k", "label", 20, 5)
    assert [sum(x == label for x, _ in some) for label in range(3)] == [20, 20, 20] and set(some) <= set(got)
    same = spark.createDataFrame([(1,)] * 50 + [(2,)], "k long")
    assert sorted(labelled.spread_ids(same, "k", None, 10, 5)) == [(0, 1), (0, 2)]  # a repeated key counts once
    hot = spark.createDataFrame([(i % 500 if i % 3 else 1,) for i in range(9000)], "k long")
    assert len(labelled.spread_ids(hot, "k", None, 100, 5)) == 100


def test_repeated_ids_are_learned_once(spark, monkeypatch):
    """Very many rows of one id give the fits one text."""
    labels = spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, f"text number {i} with some words", "en") for i in range(60)] + [(7, f"again {i}", "en") for i in range(3000)], "doc_id long, text string, lang string")
    seen = []
    plain_features = quality.features
    monkeypatch.setattr(quality, "features", lambda df, *a: seen.append(df.count()) or plain_features(df, *a))
    quality.fit(docs, labels)
    monkeypatch.setattr(toxicity, "_matrix", lambda rows, kept, inner=toxicity._matrix: seen.append(rows.count()) or inner(rows, kept))
    toxicity.fit(docs, labels)
    assert seen == [60, 60]
    (name, text), = language.sample(docs)
    assert name == "en" and text.count("\0") < 60


def test_distinct_values():
    for n in (0, 1, 2, 1000):
        values = np.random.default_rng(n).integers(0, 300, n).astype(np.uint64)
        assert np.array_equal(textops.distinct(values), np.array(sorted(set(values.tolist())), np.uint64))
