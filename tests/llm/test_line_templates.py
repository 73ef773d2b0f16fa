from noveltybench.llm import line_templates


def text_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_templates_with_variable_fields_recur(spark):
    rows = [(i, f"unique opening line number {w} here\nServed by host web{i} in {i * 7} milliseconds for user {w}\nshort one") for i, w in enumerate(["ann", "bob", "cat", "dan", "eve"])]
    rows.append((9, "Served by three quite different words that only share their beginning"))
    left = text_of(line_templates.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert left[0].count("\n") == 2
    for i in range(1, 5):
        assert "Served by" not in left[i] and left[i].endswith("short one")
    assert left[9] == rows[-1][1]


def test_long_passages_stay_once(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, f"a line of document {'abcdefgh'[i]} alone, not elsewhere {'qwertyui'[i] * 9}\n{passage}") for i in range(8)]
    left = text_of(line_templates.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(passage in t for t in left.values()) == 1 and passage in left[0]


def test_one_document_is_no_recurrence(spark):
    rows = [(1, "the same line in two documents only"), (2, "the same line in two documents only"), (3, "one line twice in one text\none line twice in one text\none line twice in one text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert text_of(line_templates.dedup(docs)) == dict(rows) | {2: ""}
    assert text_of(line_templates.dedup(docs, min_docs=3)) == dict(rows)


def test_families_of_one_leaf_recur_each(spark):
    rows = [(i, f"Served by host alpha{i * 'x'} with a warm cache in region north") for i in range(1, 8)]
    rows += [(i, f"Served by host and then beta{i * 'y'} was closed for all users") for i in range(11, 18)]
    left = text_of(line_templates.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3))
    assert {k for k, t in left.items() if t} == {1, 11}


def test_long_lines_are_compared_by_token(spark):
    rows = []
    for doc in range(6):
        words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(64)]
        for at in range(4, 64, 8):
            words[at] = f"v{'abcdef'[doc]}{chr(97 + at % 26)}"
        rows.append((doc, " ".join(words)))
    left = text_of(line_templates.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3))
    assert [k for k, t in sorted(left.items()) if t] == [0]


def test_short_lines_need_more_than_their_leading_tokens(spark):
    rows = [(1, "this cat is black"), (2, "this cat is here"), (3, "this cat is gone")]
    assert text_of(line_templates.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == dict(rows)


def parsed(rows, min_docs):
    """What is left of each text, by the definition, line against line."""
    import math
    import re

    found = []
    for doc, text in rows:
        for place, line in enumerate(text.split("\n")):
            tokens = re.sub("[0-9]+", "<*>", line.strip(" ")).split(" ")
            if len(tokens) >= 4:
                found.append((doc, place, tuple(tokens)))
    forms = {}
    for doc, place, tokens in found:
        forms[tokens] = min(forms.get(tokens, (doc, place)), (doc, place))
    opening = {}
    for tokens, first in forms.items():
        rest = len(tokens) - 3
        for b in range(8):
            one, two = 3 + int(rest * (b + 0.5) / 8), 3 + int(rest * ((3 * b + 1) % 8 + 0.5) / 8)
            key = (len(tokens), tokens[:3], b, tokens[one], tokens[two])
            opening.setdefault(key, []).append((first, tokens))
    follows = {(t, t) for t in forms}
    for members in opening.values():
        template = min(members)[1]
        for _, t in members:
            n = len(t)
            if sum(x == y for x, y in zip(t, template, strict=True)) >= max(math.ceil(0.7 * n), 3 + math.ceil((n - 3) / 2)):
                follows.add((t, template))
    docs_of = {}
    for doc, _, tokens in found:
        for t, template in follows:
            if t == tokens:
                docs_of.setdefault(template, set()).add(doc)
    gone = {(doc, place) for doc, place, tokens in found for t, template in follows if t == tokens and len(docs_of[template]) >= min_docs and doc > min(docs_of[template])}
    return {doc: "\n".join(line for place, line in enumerate(text.split("\n")) if (doc, place) not in gone) for doc, text in rows}


def test_equals_brute_force(spark):
    import random

    rnd = random.Random(4)
    families = [[f"f{k}w{i}" if i > 2 else f"lead{i}" for i in range(12 + k % 2)] for k in range(6)]
    rows = []
    for doc in range(40):
        lines = []
        for _ in range(4):
            words = list(rnd.choice(families))
            for _ in range(rnd.randint(0, 5)):
                words[rnd.randrange(len(words))] = rnd.choice(["p", "q", "r", "7", "12"])
            lines.append(" ".join(words))
        rows.append((doc, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (2, 3):
        assert text_of(line_templates.dedup(docs, min_docs=least)) == parsed(rows, least)


def test_clashing_names_pass(spark):
    docs = spark.createDataFrame([(1, "a line of some words", 5, "x"), (2, "a line of some words", 6, "y")], "doc_id long, text string, n_lines long, __places string")
    got = line_templates.dedup(docs.withColumnRenamed("n_lines", "__doc"))
    assert sorted((r["doc_id"], r["text"], r["__doc"], r["__places"]) for r in got.collect()) == [(1, "a line of some words", 5, "x"), (2, "", 6, "y")]
    assert [tuple(r) for r in line_templates.drop_recurring(docs).collect()] == [(1, "a line of some words", 5, "x")]


def test_odd_rows(odd_docs, no_docs):
    got = line_templates.dedup(odd_docs)
    assert got.count() == odd_docs.count() and {"n_lines", "n_dropped"} <= set(got.columns)
    by = {r["doc_id"]: r for r in got.collect()}
    assert (by[2]["text"], by[2]["n_lines"]) == (None, 0) and (by[3]["text"], by[3]["n_lines"]) == ("", 1)
    assert line_templates.drop_recurring(odd_docs).columns == odd_docs.columns
    assert line_templates.digest(no_docs).collect() == []


def test_plan_is_native(odd_docs):
    plan = line_templates.dedup(odd_docs)._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))
