import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tarnfold.functions import answers as a
from tarnfold.operators import sampling as s


@pytest.mark.parametrize(
    ("predicted", "gold", "problem", "how"),
    [
        ("\\boxed{\\frac{1}{2}}", "0.5", "", "fraction_decimal_match"),
        ("3 apples", "3", "", "unit_stripped_match"),
        ("2, 1", "{1,2}", "", "comma_set_match"),
        ("2,1", "1,2", "", "no_match"),
        ("2,1", "1,2", "Find all x", "comma_set_match"),
        ("2\\pi", "2*pi", "", "latex_pi_match"),
        ("4", "4.0000001", "", "numeric_match"),
        ("101 in base 2", "101_2", "", "exact_string"),
        ("", "", "", "no_match"),
        (None, None, "", "no_match"),
        ("{(1,2)}", "(1,2)", "", "exact_string"),
    ],
)
def test_verify(predicted, gold, problem, how):
    assert a.verify(predicted, gold, problem).verification_method == how


@pytest.mark.parametrize(
    ("text", "answer"),
    [
        ("[Final Answer]\n\\boxed{42}", "42"),
        ("[Final Answer]\nThe answer is $7$", "7"),
        ("x \\boxed{a{b}} y \\boxed{open", "a{b}"),
        ("FINAL_ANSWER: 9", "9"),
        ("Final answer: 11\nbye", "11"),
        ("line\n\\[\n5\n\\]", "line"),
        ("", ""),
        (None, ""),
    ],
)
def test_final_answer(text, answer):
    assert a.final_answer(text) == answer


def test_evaluate_is_bounded():
    assert a.evaluate("9^9^9^9") is None
    assert a.evaluate("1/0") is None
    assert a.evaluate("(-8)^(1/3)") is None
    assert a.evaluate("2(3)") is None
    assert a.evaluate("2*pi") == pytest.approx(2 * math.pi)
    assert a.evaluate("-(3+4)/2") == -3.5


@given(st.text(max_size=60))
def test_any_text_is_handled(text):
    a.sections(text)
    a.free_answer(text)
    assert a.verify(text, text).correct == bool(a.normalise(text).normalized)


@given(st.integers(0, 500), st.integers(0, 500), st.floats(0, 1))
def test_rebalance(x, y, share):
    p, q = s.rebalance(x, y, share)
    assert 0 <= p <= x and 0 <= q <= y


def test_ratios():
    assert s.ratios({"a": 3, "b": 1, "c": -5}) == {"a": 0.75, "b": 0.25, "c": 0.0}
    with pytest.raises(ValueError):
        s.ratios({"a": 0.0})
