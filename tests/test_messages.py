"""Array builders against plain loops over random dialogues."""

import random

from pyspark.sql import functions as F

from colloquy.functions import coerce, messages

c = F.col
DDL = "m array<struct<role:string,content:string>>"


def dialogues(n, seed, roles=("user", "assistant"), words=6):
    rng = random.Random(seed)
    out = [[]]
    for _ in range(n):
        ms = []
        if rng.random() < 0.5:
            ms.append(("system", " ".join("s" * rng.randint(0, 3))))
        for _ in range(rng.randint(0, 15)):
            content = rng.choice([None, "", "  ", " ".join(rng.choice("abcd") for _ in range(rng.randint(1, words)))])
            ms.append((rng.choice(roles), content))
        out.append(ms)
    return out


def plain(got):
    return None if got is None else [(m["role"], m["content"]) for m in got]


def tokens(content):
    return (content or "").split()


def is_head(ms):
    return [m for m in ms[:1] if m[0] == "system"]


def ends(ms):
    """Every way to keep the system message and an end of the rest, the longest first."""
    rest = ms[len(is_head(ms)) :]
    return [is_head(ms) + rest[i:] for i in range(len(rest) + 1)]


def check_trimmed(got, ms, limit):
    """The longest such end of at most ``limit`` messages; all of them where no limit can hold."""
    if limit <= len(is_head(ms)):
        assert got == ms
    else:
        assert got in ends(ms) and len(got) == min(limit, len(ms))


def test_trim_history(ev):
    data = dialogues(60, 1) + [[("system", "s")] + [("user", str(i)) for i in range(14)], [("user", str(i)) for i in range(15)]]
    for limit in (0, 1, 2, 9, 12):
        got = ev([(d,) for d in data], DDL, messages.trim_history(c("m"), limit))
        for g, d in zip(got, data, strict=True):
            check_trimmed(plain(g), d, limit)


def total(ms):
    return sum(len(tokens(content)) for _, content in ms)


def check_truncated(got, ms, limit):
    """An end within the limit, and the next longer one is not; the shortest where none is within."""
    longer_first = ends(ms)
    at = longer_first.index(got)
    if limit > 0:
        assert total(got) <= limit or at == len(longer_first) - 1
        assert at == 0 or total(longer_first[at - 1]) > limit
    else:
        assert got == ms


def test_truncate_tail(ev):
    data = dialogues(120, 2)
    for limit in (0, 1, 3, 8, 40):
        got = ev([(d,) for d in data], DDL, messages.truncate_tail(c("m"), limit))
        for g, d in zip(got, data, strict=True):
            check_truncated(plain(g), d, limit)


def check_fitted(got, ms, budget):
    """As a truncation while a message of the rest is left whole; else the last message's own end."""
    rest = ms[len(is_head(ms)) :]
    whole = [e for e in ends(ms)[: len(rest)] if total(e) <= budget]
    if budget <= 0 or not ms or total(ms) <= budget:
        assert got == ms
    elif whole:
        assert got == max(whole, key=len)
    elif not rest:
        assert got == is_head(ms)
    else:
        (role, content), room = rest[-1], max(budget - total(is_head(ms)), 0)
        assert got[:-1] == is_head(ms) and got[-1][0] == role
        if content:
            words = tokens(got[-1][1])
            assert words == tokens(content)[len(tokens(content)) - len(words) :] and len(words) == min(room, len(tokens(content)))
        else:
            assert got[-1][1] == content


def test_fit_token_budget(ev):
    data = dialogues(150, 3, words=9)
    for budget in (0, 1, 2, 4, 9, 30):
        got = ev([(d,) for d in data], DDL, messages.fit_token_budget(c("m"), budget))
        for g, d in zip(got, data, strict=True):
            check_fitted(plain(g), d, budget)


def test_overheads_count_against_the_budget(ev):
    ms = [("system", "s"), ("user", "a b"), ("assistant", "c d")]
    # 2 per message, 1 per dialogue: 1 + (1+2) + (2+2) + (2+2) = 12
    cut = lambda n: messages.truncate_tail(c("m"), n, per_message=2, per_dialogue=1)
    assert plain(ev([(ms,)], DDL, cut(12))[0]) == ms
    assert plain(ev([(ms,)], DDL, cut(11))[0]) == [ms[0], ms[2]]
    fit = messages.fit_token_budget(c("m"), 7, per_message=2, per_dialogue=1)
    assert plain(ev([(ms,)], DDL, fit)[0]) == [ms[0], ("assistant", "d")]


def test_tokenizers_in_python(spark):
    """Token counts and tokens from a pandas_udf: here every character is a token."""
    from pyspark.sql.types import ArrayType, IntegerType, StringType

    @F.pandas_udf(ArrayType(IntegerType()))
    def lengths(ms):
        return ms.map(lambda row: [len(m["content"] or "") for m in row])

    @F.pandas_udf(ArrayType(ArrayType(StringType())))
    def letters(ms):
        return ms.map(lambda row: [list(m["content"] or "") for m in row])

    df = spark.createDataFrame([([("system", "s"), ("user", "abc"), ("user", "de f")],)], DDL)
    counted = df.withColumns({"n": lengths("m"), "tokens": letters("m")})
    one = counted.select(messages.truncate_tail(c("m"), 5, counts=c("n")).alias("x")).first()["x"]
    assert plain(one) == [("system", "s"), ("user", "de f")]
    fit = messages.fit_token_budget(c("m"), 4, join="", token_lists=c("tokens"))
    assert plain(counted.select(fit.alias("x")).first()["x"]) == [("system", "s"), ("user", "e f")]


def test_token_budget(ev):
    assert ev([(1,)], "x int", messages.token_budget(4096, 1024)) == [3040]
    assert ev([(1,)], "x int", messages.token_budget(512, 400)) == [256]


def test_contexts(ev):
    rows = [
        ([("user", "q"), ("", "x"), (None, "y"), ("assistant", None), ("assistant", "a")],),
        ([("assistant", "a")],),
        (None,),
        ([],),
    ]
    cleaned = messages.clean_context(c("m"))
    assert [plain(g) for g in ev(rows, DDL, cleaned)] == [[("user", "q"), ("assistant", "a")], [("assistant", "a")], [], []]
    assert [plain(g) for g in ev(rows, DDL, messages.drop_trailing_assistant(cleaned))] == [[("user", "q")], [], [], []]
    repaired = messages.repair_generator_context(messages.drop_trailing_assistant(cleaned), F.lit("Q"))
    got = [plain(g) for g in ev(rows + [([("system", "s")],)], DDL, repaired)]
    assert got[0] == [("user", "q")]
    assert got[1][1] == ("user", "Q") and got[1][0][0] == "system"
    assert got[4] == [("system", "s"), ("user", "Q")]


def test_normalise_shapes(ev):
    rows = {
        None: [(None, None)],
        "plain": [("user", "plain")],
        "": [("user", "")],
        "5": [("user", "5")],
        "null": [("user", None)],
        '"s"': [("user", "s")],
        "[]": [(None, None)],
        '{"role":"user","content":"x"}': [("user", "x")],
        '[{"role":"user","content":{"a":[1,2]}}]': [("user", '{"a":[1,2]}')],
        '[[{"role":"a","content":"b"},{"content":"d"}],["p","q",5]]': [("a", "b"), (None, "d"), ("user", "p q 5")],
        '["a",{"role":"user","content":"x"},null,[]]': [("user", "a"), ("user", "x"), ("user", None)],
        '[["x",null]]': [("user", "x None")],
        "[null]": [("user", None)],
        "[[]]": [(None, None)],
        '[{"role":"u","content":"\\u00e9 \\n"}]': [("u", "é \n")],
        "{broken": [("user", "{broken")],
    }
    got = ev([(k,) for k in rows], "t string", messages.normalise_messages(c("t")))
    assert [plain(g) for g in got] == list(rows.values())


def test_question_from_any_shape(ev):
    rows = {
        '"text"': "text",
        "null": "",
        '{"from":"Human","value":"v","content":""}': "v",
        '{"role":"assistant","content":"","question":"q"}': "q",
        '{"role":"user"}': "",
        '[{"role":"user","content":"first"},{"role":"assistant","content":"x"}]': "first",
        '[{"role":"user","content":"first"},"plain",{"role":"assistant","content":"x"}]': "plain",
        '[{"role":"assistant","content":"x"},{"role":"user","content":""},"  "]': "x",
        '[{"speaker":"QA.User","message":"m"}]': "m",
        "[]": "",
    }
    got = ev([(k,) for k in rows], "t string", coerce.question_from_variant(F.parse_json("t")))
    assert got == list(rows.values())
    assert ev([(["a", " ", "b", ""],), ([" "],)], "a array<string>", coerce.question_from_strings(c("a"))) == ["b", ""]


def test_rows_with_open_schemas(spark):
    none = spark.createDataFrame([(1, "q1"), (2, "")], "id int, question string")
    got = coerce.with_question_and_truth(none, "d").orderBy("id").collect()
    assert [r["question"] for r in got] == ["q1", None]
    assert [r["ground_truth"] for r in got] == [None, None]
    strict = coerce.with_question_and_truth(none, "d", accept_question=False).collect()
    assert [r["question"] for r in strict] == [None, None]

    deep = spark.createDataFrame(
        [
            (None, [("assistant", "so \\boxed{4}"), ("assistant", "5")], ("x", None)),
            (None, [("assistant", "just text")], ("x", None)),
            ("", [("assistant", "")], ("", "g")),
            ("raw \\boxed{1}", [], (None, None)),
        ],
        "solution string, messages array<struct<role:string,content:string>>, content struct<answer:string,gt:string>",
    )
    got = [r["ground_truth"] for r in coerce.with_question_and_truth(deep, "d").collect()]
    assert got == ["4", "just text", "g", "raw \\boxed{1}"]
    variant = spark.sql("""SELECT parse_json('{"answer":"","gt":7}') AS content""")
    assert coerce.with_question_and_truth(variant, "d").first()["ground_truth"] == "7"
