import random

import pytest

from noveltybench.llm import near_dup


def brute(rows, shingle, percent):
    """doc -> (set size, component) by comparing all pairs."""
    sets = {}
    for doc, text in rows:
        words = [w for w in (text or "").encode().lower().split()]
        grams = {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)} or ({tuple(words)} if words else set())
        sets[doc] = grams
    label = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


def corpus(seed, groups, size, edits):
    rnd = random.Random(seed)
    rows, doc = [], 0
    for _ in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.randint(0, edits)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
            rows.append((doc, " ".join(words)))
            doc += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("groups", "size", "shingle", "percent"), [(12, 5, 3, 85), (1, 60, 3, 85), (3, 20, 5, 80)])
def test_groups_equal_brute_force(spark, groups, size, shingle, percent):
    rows = corpus(groups, groups, size, 6)
    got = near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string"), shingle, percent).collect()
    want = brute(rows, shingle, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(odd_docs):
    got = near_dup.groups(odd_docs, 3, 85).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[8]["component_id"] == 1 and not by[8]["kept"] and by[1]["kept"]
    for d in (2, 3, 4):
        assert (by[d]["n_shingles"], by[d]["component_id"], by[d]["kept"]) == (0, d, True)
    assert by[5]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"]
    kept = near_dup.keep_one(odd_docs, 3, 85)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 2, 3, 4, 5, 6, 7]


def test_empty_table(no_docs):
    assert near_dup.groups(no_docs).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in near_dup.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_regular_long_words_differ(spark):
    """Words whose polynomial hashes modulo 2**64 are equal in any base."""
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    got = near_dup.groups(spark.createDataFrame([(1, a), (2, b), (3, b)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 2}


def test_texts_of_one_id_are_one_document(spark):
    """An id's texts are linked through the id, whichever of them is alike another document."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abc"}
    rows = [(5, text["a"]), (5, text["b"]), (5, text["b"].upper()), (5, text["b"]), (6, text["b"] + " more"), (9, text["a"] + " end"), (7, text["c"])]
    got = near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(5, 5, True)] * 4 + [(6, 5, False), (7, 7, True), (9, 5, False)]


def test_hot_group_of_near_copies(spark):
    """Hundreds of copies, many of them alike only the least edited ones: as all pairs say."""
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for doc in range(600):
        words = list(base)
        for _ in range(min(int(rnd.expovariate(0.25)), 20)):
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(300)}"
        rows.append((doc, " ".join(words)))
    want = brute(rows, 3, 85)
    assert len({c for _, c in want.values()}) > 50
    got = near_dup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
