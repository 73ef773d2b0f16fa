import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from noveltybench.llm import byte_bpe, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NONE = dict(n_a=0, n_b=0, n_groups=0, n_links=0, n_best=0, count_sum=0, groups_sha256="")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(tokenizers, text):
    """(id, first byte, end byte) of each token of either side, from the libraries; None where bytes differ."""
    a, b = tokenizers
    if not text:
        return None
    back = {c: v for v, c in byte_bpe.byte_to_char().items()}
    left = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    out = []
    for side in (left, right):
        if b"".join(t for _, t in side) != (" " + text).encode():
            return None
        at, placed = 0, []
        for i, t in side:
            placed.append((i, at, at + len(t)))
            at += len(t)
        out.append(placed)
    return out


def brute(tokenizers, docs):
    """The query's rows by comparing all tokens of a text with all others."""
    found, counts = [], Counter()
    for key, text in docs:
        sides = tokens(tokenizers, text)
        if sides is None:
            found.append((key, None, None, None))
            continue
        links = [(i, j) for i, s, e in sides[0] for j, f, g in sides[1] if s < g and f < e]
        ends = sorted({e for *_, e in sides[0]} & {e for *_, e in sides[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, _, e in side if start < e <= end) for side in sides))
            start = end
        found.append((key, sides, links, groups))
        counts.update(set(links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    rows = []
    for key, sides, links, groups in found:
        if sides is None:
            rows.append(dict(doc_id=key, **NONE))
            continue
        text = ";".join(groups).encode()
        rows.append(dict(doc_id=key, n_a=len(sides[0]), n_b=len(sides[1]), n_groups=len(groups), n_links=len(links), n_best=sum(counts[x] == best[x[0]] for x in links),
                         count_sum=sum(counts[x] for x in links), groups_sha256=hashlib.sha256(text).hexdigest()))
    return rows


def ordered(rows):
    return sorted((tuple((k, str(r[k])) for k in ("doc_id", *NONE)) for r in rows))


TEXTS = [None, "", " ", "  ", "a", "a ▁ b", "naïve <s> <|endoftext|> </s> x", "tab\tand\r\nline\n\n  indented", "漢字 and 😀 split", "the the the the", "\x00", "x" * 3000, " lead", "trail  "]


def test_query_equals_all_pairs(spark, tokenizers):
    random.seed(4)
    parts = ["a", "b", " ", "  ", "\n", "é", "漢", "😀", "\t", "<s>", "the ", "ing", "\r", "\xa0", "."]
    docs = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(1000 + i, "".join(random.choices(parts, k=random.randint(0, 25)))) for i in range(300)] + [(None, "no id"), (None, "no id")]
    df = spark.createDataFrame([(k, t, 5, "x") for k, t in docs], "doc_id long, text string, n_a int, pairs string").repartition(5)
    want = ordered(brute(tokenizers, docs))
    assert ordered(token_alignment.digest(df, A, B).collect()) == want
    assert ordered(token_alignment.digest(df, A, B, most_pairs=0).collect()) == want  # by the join


def test_query_equals_all_pairs_on_the_table(spark, tokenizers):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert len(docs) > 100 and ordered(token_alignment.digest(df, A, B).collect()) == ordered(brute(tokenizers, docs))


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.digest(df, A, B).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for most in (0, 10):
        assert ordered(token_alignment.digest(nothing, A, B, most).collect()) == ordered([dict(doc_id=k, **NONE) for k in (1, 2)])


def test_spans_of_the_general_interface(spark, tokenizers):
    df = spark.createDataFrame([("k", "Unbelievable naïve tokens", 1), ("n", None, 2)], "name string, text string, links int")
    got = {r["name"]: r for r in token_alignment.alignments(df, A, B).collect()}
    left, right = tokens(tokenizers, "Unbelievable naïve tokens")
    row = got["k"]
    assert row["a_ids"] == [t[0] for t in left] and row["b_ids"] == [t[0] for t in right]
    assert {(x["a"], x["b"]) for x in row["links"]} == {(i, j) for i, (_, s, e) in enumerate(left) for j, (_, f, g) in enumerate(right) if s < g and f < e}
    assert [(left[x["a"] - 1][2], right[x["b"] - 1][2]) for x in row["groups"]] == [(e, e) for e in sorted({t[2] for t in left} & {t[2] for t in right})]
    assert (got["n"]["a_ids"], got["n"]["links"], got["n"]["groups"]) == ([], [], [])


def test_long_runs(spark):
    """A run of white space beyond what a regular expression can track, and a text of many slices."""
    docs = [(1, " " * 400_000), (2, "word " * 300_000)]
    got = {r["doc_id"]: r for r in token_alignment.digest(spark.createDataFrame(docs, "doc_id long, text string"), A, B).collect()}
    assert got[1]["n_a"] > 0 and got[2]["n_a"] == 300_001 and got[2]["n_groups"] > 299_000
