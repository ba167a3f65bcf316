"""Scalar builders on edge rows; expected values follow from the stated semantics."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from colloquy.functions import grading, hashing, text

c = F.col


def test_verdict(ev):
    rows = {
        "": None, "123": None, "It is Correct.": "correct", "**incorrect**\n": "incorrect", "so wrong!!": "incorrect",
        "correct 100%": "correct", "not correct": "correct", "correctness": None, "correct é": "correct",
        "wrongé": "incorrect", "CORRECT": "correct", "correct but no": None,
    }
    assert ev([(k,) for k in rows], "t string", text.final_verdict(c("t"))) == list(rows.values())
    assert ev([(None,)], "t string", text.final_verdict(c("t"))) == [None]


@pytest.mark.parametrize("s", ["\x1c a \x1f", "\u3000b\xa0", "\x85c\n", "\ufeffd ", " e\u200b", "", " \t ", "f"])
def test_strip_is_pythons(ev, s):
    assert ev([(s,)], "t string", text.py_strip(c("t"))) == [s.strip()]


def test_think(ev):
    rows = [("<think>a</think> b </think> c ",), ("<think>a",), ("plain ",), ("",), (None,), ("x</think>",)]
    assert ev(rows, "t string", text.strip_think(c("t"))) == ["b </think> c", "<think>a", "plain ", "", None, ""]
    assert ev(rows, "t string", text.think_incomplete(c("t"))) == [False, True, False, False, False, False]


def test_boxes(ev):
    rows = [
        ("x \\boxed{\\frac{1}{2}} y \\boxed{3}",), ("none",), ("\\boxed{}",), ("\\boxed{a} \\boxed{b{c{d}}}",),
        ("\\boxed{open",), ("\\boxed{\\frac{1}{2}}",), (None,), ("\\boxed{" + "9" * 50_000 + "}",),
        ("\\boxed{7} \\boxed{\\frac{\\sqrt{a_{1}}}{2}}",), ("\\boxed{7} \\boxed{{{open}",), ("\\boxed{" + "{" * 60 + "}" * 60 + "} x",),
    ]
    assert ev(rows, "t string", text.boxed_first(c("t"))) == [
        "\\frac{1", None, None, "a", None, "\\frac{1", None, "9" * 50_000, "7", "7", "{" * 60
    ]
    assert ev(rows, "t string", text.boxed_last(c("t"))) == [
        "3", None, None, "b{c{d}}", None, "\\frac{1}{2}", None, "9" * 50_000,
        "\\frac{\\sqrt{a_{1}}}{2}", "7", "{" * 60 + "}" * 60,
    ]


def test_tags(ev):
    rows = [("a <Fixed_Answer> x\ny </fixed_answer> <fixed_answer>z</fixed_answer>",), ("<fixed_answer></fixed_answer>",), ("no",)]
    assert ev(rows, "t string", text.fixed_answer(c("t"))) == ["x\ny", "", None]


def test_snippet(ev):
    rows = [(" a\nb ",), ("x" * 120,), ("x" * 121,), (None,)]
    assert ev(rows, "t string", text.question_snippet(c("t"))) == ["a b", "x" * 120, "x" * 117 + "...", ""]


def test_routing(ev):
    keys = ["abc:0", "", "é:1", "train_17:0"]
    for n in (1, 2, 8):
        want = [zlib.crc32(k.encode()) % n for k in keys]
        assert ev([(k,) for k in keys], "t string", text.routing_slot(c("t"), n)) == want


def test_split_key():
    assert text.split_key("a/b:c[1:2]") == "a_b-c1-2"


def test_hash_of_text_and_messages(ev):
    import hashlib

    messages = [
        [{"role": "user", "content": 'q "x"\n\té \\ /'}, {"role": None, "content": None}],
        [],
        [{"role": "a", "content": ""}],
    ]
    rows = [([(m["role"], m["content"]) for m in ms],) for ms in messages]
    want = [
        hashlib.sha1(json.dumps(ms, ensure_ascii=False, sort_keys=True).encode()).hexdigest() for ms in messages
    ]
    assert ev(rows, "m array<struct<role:string,content:string>>", hashing.message_hash(c("m"))) == want


GRADES = [
    ("\\boxed{1}", "1", True),
    ("\\boxed{ 1.0 }", "1", True),
    ("\\boxed{\\dfrac{1}{2}}", "0.5", True),
    ("\\boxed{1/2}", "\\frac{1}{2}", True),
    ("\\boxed{-\\frac{3}{6}}", "-0.5", True),
    ("\\boxed{$1,234$.}", "1234", True),
    ("\\boxed{12,34}", "1234", False),
    ("\\boxed{(1,234)}", "(1234)", False),
    ("\\boxed{1/0}", "1/0", True),
    ("\\boxed{1/0}", "2/0", False),
    ("\\boxed{x+1}", "x + 1", True),
    ("\\boxed{\\left(1, 2\\right)}", "(1,2)", True),
    ("1", "1", False),
    ("\\boxed{2} then \\boxed{3}", "so \\boxed{3}", True),
    ("\\boxed{3}", "", False),
    ("\\boxed{1d}", "1", False),
    ("\\boxed{0}", "0.0", True),
    ("\\boxed{1000000000}", "1000000001", True),
    ("\\boxed{1000000}", "1000001", False),
]


def test_grades(ev):
    rows = [(a, g) for a, g, _ in GRADES]
    assert ev(rows, "a string, g string", grading.grade(c("a"), c("g"))) == [w for *_, w in GRADES]


def test_missing_truth_and_empty_answer(ev):
    rows = [("\\boxed{1}", None), ("\\boxed{1}", ""), ("", "1"), (None, "1"), ("\\boxed{1}", "1"), ("\\boxed{2}", "1"), ("\\boxed{0}", "0")]
    assert ev(rows, "a string, g string", grading.answer_is_correct(c("a"), c("g"))) == [
        None, None, False, False, True, False, True
    ]
    expected = grading.expected_verdict(c("a"), F.lit("\\boxed{1}"), c("g"))
    assert ev(rows, "a string, g string", expected) == [
        None, None, "correct", "correct", "correct", "incorrect", "correct"
    ]


def test_grader_can_be_replaced(ev):
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def same_length(a, g):
        return (a.str.len() == g.str.len()).astype("float64")

    rows = [("ab", "cd"), ("abc", "d")]
    graded = grading.answer_is_correct(c("a"), c("g"), same_length)
    assert ev(rows, "a string, g string", graded) == [True, False]
