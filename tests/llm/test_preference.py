from noveltybench.llm import preference

TURNS = "array<struct<role:string,text:string>>"


def formatted(spark, chosen, rejected):
    df = spark.createDataFrame([(1, chosen, rejected)], f"pair_id long, chosen {TURNS}, rejected {TURNS}")
    return preference.format_pairs(df).first()


def rendered(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def test_common_prefix_is_rendered_once(spark):
    shared = [("system", "Be kind."), ("user", "Hi"), ("assistant", "Hello"), ("user", "More?")]
    a, b = [*shared, ("assistant", "Good"), ("user", "ok"), ("assistant", "Bye")], [*shared, ("assistant", "Bad")]
    r = formatted(spark, a, b)
    assert r["n_prompt_turns"] == 4 and r["prompt"] == rendered(shared)
    assert r["chosen"] == rendered(a[4:]) and r["rejected"] == rendered(b[4:])
    learned = [r["chosen"][int(s) : int(e)] for s, e in (x.split("-") for x in r["chosen_spans"].split(","))]
    assert learned == ["Good<|end|>\n", "Bye<|end|>\n"]


def test_cases(spark):
    turns = [("user", "a"), ("assistant", None)]
    same = formatted(spark, turns, turns)
    assert (same["n_prompt_turns"], same["chosen"], same["rejected"], same["chosen_spans"]) == (2, "", "", "")
    none = formatted(spark, None, turns)
    assert (none["n_prompt_turns"], none["prompt"], none["chosen"], none["rejected"]) == (0, "", "", rendered(turns))
    prefix = formatted(spark, turns[:1], turns)
    assert (prefix["n_prompt_turns"], prefix["chosen"], prefix["rejected"]) == (1, "", rendered(turns[1:]))
    apart = formatted(spark, [("user", "a")], [("user", "b")])
    assert apart["n_prompt_turns"] == 0


def test_tables_with_gaps(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (2, 0, "user", "only"), (None, 0, "user", "x"), (3, 0, None, None), (4, 1, "assistant", "b"), (4, 0, "user", "c"), (4, 1, "assistant", "b")]
    got = {r["conv_id"]: r for r in preference.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert got[0]["prompt"] == rendered([("user", "q")]) and got[0]["rejected"] == rendered([("assistant", "a1")])
    assert got[2]["prompt"] == rendered([("user", "only")]) and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[4]["rejected"] == "" and got[4]["chosen"] == rendered([("assistant", "b")]) and got[4]["prompt"] == rendered([("user", "c"), ("assistant", "b")])
    assert preference.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_plan_is_native(spark):
    rows = spark.createDataFrame([(0, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    plan = preference.digest(rows)._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))


def test_all_turns_are_kept(spark):
    """Turns after the last reply stand on both sides; negative ids have partners too."""
    rows = [(-2, 0, "user", "q"), (-2, 1, "assistant", "a"), (-2, 2, "user", "thanks"), (-2, 3, "user", "bye"), (-1, 0, "user", "w"), (-1, 1, "assistant", "z"), (7, 0, "user", "u"), (7, 1, "assistant", "v"), (7, 2, "tool", "t")]
    got = {r["conv_id"]: r for r in preference.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    tail = [("user", "thanks"), ("user", "bye")]
    assert got[-2]["prompt"] == rendered([("user", "q")]) and got[-2]["chosen"] == rendered([("assistant", "a"), *tail]) and got[-2]["rejected"] == rendered([("assistant", "z"), *tail])
    assert got[-1]["rejected"] == rendered([("assistant", "a")]) and got[7]["rejected"] == rendered([("tool", "t")])
    assert [got[-2]["chosen"][int(a) : int(b)] for a, b in [got[-2]["chosen_spans"].split("-")]] == ["a<|end|>\n"]


def test_clashing_names_pass(spark):
    df = spark.createDataFrame([(1, 2, 3, [("user", "a")], [("user", "a"), ("assistant", "b")])], f"__c int, __r int, __prompt int, chosen {TURNS}, rejected {TURNS}")
    r = preference.format_pairs(df).first()
    assert (r["__c"], r["__r"], r["__prompt"], r["n_prompt_turns"], r["rejected"]) == (1, 2, 3, 1, rendered([("assistant", "b")]))
