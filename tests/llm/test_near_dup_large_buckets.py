import random

from test_near_dup import brute

from noveltybench.llm import near_dup


def test_sub_groups_of_a_large_bucket_are_found(spark):
    """Sub-groups of three share one bucket, but only members of one sub-group are alike."""
    rnd = random.Random(5)
    core = [f"core{i}" for i in range(400)]
    rows, doc = [], 0
    for g in range(30):
        for _ in range(3):
            rows.append((doc, " ".join(core + [f"own{g}x{i}" for i in range(40)] + [f"x{rnd.randrange(10**9)}" for _ in range(2)])))
            doc += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near_dup.signatures(docs, 1, bands=1, rows=1).withColumnRenamed("doc_id", "rep")
    buckets = {}
    for r in near_dup.table_keys(signed, bands=1).collect():
        buckets.setdefault(r["key"], set()).add(r["rep"])
    shared = max(buckets.values(), key=len)
    assert len(shared) > 9 * near_dup.SMALL // 2
    rows = [r for r in rows if r[0] in shared]
    got = near_dup.groups(docs.where(docs["doc_id"].isin(*shared)), 1, 85, bands=1, rows=1).collect()
    want = brute(rows, 1, 85)
    assert len({c for _, c in want.values()}) > 10
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
