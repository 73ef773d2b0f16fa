import hashlib
import random
import re

import pytest

from noveltybench.llm import decontam

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, n=10):
    windows = {}
    for name, text in items:
        w = words(text)
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for size in {len(g) for g in windows}:
            for i in range(len(w) - size + 1):
                found = windows.get(tuple(w[i : i + size]))
                if found:
                    hit |= set(range(i, i + size))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=lambda r: (r[0] is None, r[0]))


def sample(seed):
    rnd = random.Random(seed)
    vocab = [f"v{i}é" if i % 7 == 0 else f"V{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([0, 1, 4, 9, 10, 11, 30])))) for i in range(25)] + [(99, None)]
    docs = []
    for d in range(60):
        parts = rnd.choices(vocab, k=rnd.randint(0, 60))
        if d % 3 == 0:
            at = rnd.randint(0, len(parts))
            parts[at:at] = (rnd.choice(items)[1] or "").split()
        docs.append((d, rnd.choice([" ", ", ", "\n"]).join(parts)))
    return docs + [(100, None), (101, "")], items


@pytest.mark.parametrize(("most", "most_bytes"), [(200_000, 64_000_000), (0, 64_000_000), (200_000, 100)])
def test_both_ways_equal_brute_force(spark, most, most_bytes):
    """Within the bounds of a broadcast, beyond its number of windows, beyond its bytes."""
    docs, items = sample(4)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    marked = decontam.mark(d, b, max_broadcast=most, max_bytes=most_bytes)
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in marked.collect())
    assert got == brute(docs, items)


def test_spans_and_documents_go(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, f"Before it. {passage.upper()}, after it."), (2, "clean text stays as it is"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(5, passage)], "item_id long, text string")
    assert [r["doc_id"] for r in decontam.decontaminate(d, b).orderBy("doc_id").collect()] == [2, 3]
    spans = {r["doc_id"]: r["text"] for r in decontam.decontaminate(d, b, mode="span").collect()}
    assert spans == {1: "Before it. , after it.", 2: "clean text stays as it is", 3: None}
    with pytest.raises(ValueError):
        decontam.decontaminate(d, b, mode="other")


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old")], "item_id long, text string")
    got = decontam.digest(odd_docs, items).collect()
    assert len(got) == odd_docs.count() and sum(r["contaminated"] for r in got) == 3
    assert decontam.decontaminate(odd_docs, items).columns == odd_docs.columns
    assert decontam.digest(no_docs, items).collect() == []
    assert not any(r["contaminated"] for r in decontam.digest(odd_docs, items.where("false")).collect())


def test_spans_and_names_in_the_second_way(spark):
    """Beyond the broadcast bound the same spans go, and columns named like internal ones pass through."""
    passage = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before it. {passage.upper()}, after it.", 7, "x"), (2, "clean text stays as it is", 8, "y"), (1, f"Before it. {passage.upper()}, after it.", 7, "x"), (3, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, __key long, __hits string")
    b = spark.createDataFrame([(5, passage), (6, "clean text")], "item_id long, text string")
    for most in (decontam.MAX_BROADCAST, 0):
        got = sorted(((r["doc_id"], r["n_hit"], r["clean_text"], r["__key"], r["__hits"]) for r in decontam.mark(d, b, remove=True, max_broadcast=most).collect()), key=str)
        assert got == [(1, 11, "Before it. , after it.", 7, "x")] * 2 + [(2, 2, " stays as it is", 8, "y"), (3, 0, None, None, None)]
