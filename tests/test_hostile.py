"""No text kills or stalls a job; mended JSON against texts made by composition; readings, names and kernels against plain ways."""

import difflib
import itertools
import json
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfold.functions import answers as a
from tarnfold.functions import closest, jsonmend, ragged
from tarnfold.functions import text as tx
from tarnfold.operators import curate, rewards, sampling

MEGA = 1_000_000
HOSTILE = {
    "deep": "a" + "{" * MEGA + "x" + "}" * MEGA,
    "three thousand": "a" + "{" * 3000 + "x" + "}" * 3000,
    "unclosed": "{" * MEGA,
    "unopened": "}" * MEGA,
    "fractions": "\\frac{" * 40_000 + "1" + "}{2}" * 40_000,
    "boxes": "\\boxed{" * 40_000 + "}" * 40_000,
    "brackets": "(" * (MEGA // 4) + "1" + ")" * (MEGA // 4),
    "sum": "1+" * 100_000 + "1",
    "digits": "9" * MEGA,
    "headings": "[Final Answer]\n" * 60_000,
    "pi": "π " * 300_000,
    "subscripts": "x" + "₂" * MEGA + "y",
    "spaces": "1" + " " * MEGA + "_ 2",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_answers(name):
    text, began = HOSTILE[name], time.time()
    a.sections(text)
    a.free_answer(text)
    assert a.verify(text, text).correct == bool(a.normalise(text).normalized)
    a.near_misses(text, "7")
    a.solution_answer("", text)
    assert time.time() - began < 20


def test_long_expressions_have_values():
    assert a.evaluate("+".join(["1"] * 5000)) == 5000
    assert a.verify("+".join(["1"] * 5000), "5000").verification_method == "numeric_match"
    assert a.evaluate("(" * 500 + "7" + ")" * 500) == 7
    assert a.evaluate("2^1000") == 2.0**1000 and a.evaluate("2^99999") is None
    for text, value in (("-2^2", -4), ("2^-1", 0.5), ("2*-3+1", -5), ("2**3**2", 512), ("7//2*2", 6), ("1.5.5", None), ("007", None), ("1 2", None), ("()", None), ("+", None), ("1+", None), ("3(4)", None), ("", None), ("--3", 3), ("0", 0)):
        assert a.evaluate(text) == value, text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["{", "}", "\\frac", "\\text", "\\boxed{", "1", "x", " ", "\\", ",", "\\{", "/", "2"]), max_size=60))
def test_braces_of_any_kind(parts):
    text = "".join(parts)
    nodes = a.parse(text)
    flat = lambda n: "".join("{" + flat(x) + "}" if isinstance(x, list) else "\\" + x.name if isinstance(x, a.Command) else x for x in n)
    assert flat(nodes) == text
    a.sections(text)
    a.free_answer(text)
    a.verify(text, "x")


def test_json_by_composition():
    value = {"r": "\\frac{1}{2}, ] } \\n \\(x\\)", "n": [1, {"s": 2}], "q": '"'}
    body = json.dumps(value)
    loose = body.replace("\\\\", "\\")  # as models write LaTeX
    comma = body.replace("}]", "},\n ]")
    for head, tail, text in itertools.product(["", "Sure:\n", "```json\n"], ["", "\n```", " done"], [body, comma, loose]):
        got = jsonmend.parse(head + text + tail, ("r", "n"))
        # a backslash before n is a line end in JSON, whoever wrote it
        want = {**value, "r": value["r"].replace("\\n", "\n")} if text is loose else value
        assert json.loads(got.value) == want and got.source == "repaired"
    other = '{"a": 1}'
    assert json.loads(jsonmend.parse(f"{other} then {body} or {other}", ("r",), True).value) == value
    assert json.loads(jsonmend.parse(f"{{ broken {body}", ("r",), True).value) == value
    assert jsonmend.parse(f"{other} then {body}").value is None  # the published cascade has no single objects
    for text in (None, "", "prose", "{", "}{", '{"a": }', "```", '{"a": "b\\'):
        assert jsonmend.parse(text, (), True).value is None


@pytest.mark.parametrize("text", ["{" * MEGA + "}" * MEGA, '{"a":' * 200_000 + "1" + "}" * 200_000, '"' * MEGA, "," * MEGA, '{"a": "' + "\\" * (MEGA + 1) + '"}', '{"' * 300_000, "[" * MEGA], ids=range(7))
def test_hostile_json(text):
    began = time.time()
    jsonmend.parse(text, ("zz",), True)
    assert time.time() - began < 20


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text(alphabet='\\"{}[],a\n', max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=2), x, max_size=3), max_leaves=8))
def test_sound_json_stays(value):
    whole = {"v": value}
    text = json.dumps(whole)
    mended = jsonmend.mend(text)
    # only LaTeX-like escapes change
    if not any(f"\\{c}" in text for c in "bfnrt"):
        assert json.loads(mended.text) == whole
    assert mended.objects == [(0, len(mended.text))]


def test_closest_is_that_of_all_comparisons(spark, sf_dir):
    names = ["ALGERIA", "ARGENTINA", "BRAZIL", "CANADA", "CHINA", "EGYPT", "ETHIOPIA", "FRANCE", "GERMANY", "INDIA", "INDONESIA", "IRAN", "IRAQ", "JAPAN", "", "AAA", "AAB"]
    words = {w.upper() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect() for w in (r.text or "").split()}
    words = [*sorted(words)[:400], "", "A", "INDIANA", "ARGENTINA"]
    index = closest.Names(names)
    for w in words:
        assert index.closest(w) == difflib.get_close_matches(w, names, n=1, cutoff=0.0)[0], w
    assert index.compared < len(words) * len(names) / 2
    got = spark.createDataFrame([(w,) for w in words[-4:]] + [(None,)], "w string").select("w", closest.closest_name(F.col("w"), names).alias("n")).collect()
    assert {r.w: r.n for r in got}[None] is None and {r.w: r.n for r in got}["INDIANA"] == "INDIA"


def test_candidates_begin_with_the_answer(spark):
    texts = ["#### 3\nso \\boxed{4} and answer: 5\nx = 6", "the answer is ...\nanswer: 7", "", None, "[Final Answer]\n\\boxed{2}", "plain\nlines", "x = 1\nx = 2."]
    for t in texts:
        rows = list(a.free_answers(t))
        if rows and rows[0][3]:
            assert a.free_answer(t) == rows[0][:2]
        assert all(place == -1 or said in " ".join((t or "")[place : place + 200].split()) or said for said, _, place, _ in rows)
    tx.register_functions(spark)
    spark.createDataFrame(list(enumerate(texts)), "id int, t string").createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT id, c.* FROM some_texts, LATERAL answer_candidates(t) c").collect()
    assert sorted((r.id, r["rank"], r.answer, r.source, r.place) for r in got) == sorted((i, k, *c[:3]) for i, t in enumerate(texts) for k, c in enumerate(a.free_answers(t), 1))


def test_ragged_kernels():
    values = pa.array([[1.0, 2.0, 4.0], None, [], [5.0]], pa.list_(pa.float64()))
    mask = pa.array([[1, 0, 1], None, [], [0]], pa.list_(pa.int64()))
    for cut in (0, 1):  # slices have offsets of their own
        total, n = ragged.masked(values.slice(cut), mask.slice(cut))
        assert total.tolist() == [5.0, 0, 0, 0][cut:] and n.tolist() == [2, 0, 0, 0][cut:]
    with pytest.raises(ValueError):
        ragged.masked(values, pa.array([[1], None, [], [0]], pa.list_(pa.int64())))


def test_pooling(spark):
    rows = [(1, [[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0]), (2, [[1.0, 1.0]], [0]), (3, [], []), (4, None, None), (5, [[2.0, 0.0, 0.0]], [1])]
    got = {r.id: r.p for r in spark.createDataFrame(rows, "id int, v array<array<double>>, m array<int>").select("id", ragged.pool("v", "m").alias("p")).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0] and got[3] == got[4] == [] and got[5] == [1.0, 0.0, 0.0]


def test_own_reward(spark):
    @rewards.register("test_share", ("x",), "share double")
    def share(x):
        return {"share": x / x.sum()}

    try:
        t = spark.createDataFrame([("a", 2, 3.0), ("a", 1, 1.0), ("b", 1, 5.0)], "g string, i int, x double")
        assert sorted(map(tuple, rewards.apply(t, "test_share", ("g",), "i").collect())) == [("a", 1, 0.25), ("a", 2, 0.75), ("b", 1, 1.0)]
        with pytest.raises(ValueError):
            rewards.register("test_share", ("x",), "share double")(share)
    finally:
        del rewards.REGISTRY["test_share"]


def test_chosen_per_bucket(spark, monkeypatch):
    monkeypatch.setattr(sampling, "EDGE", 20)
    t = spark.range(6000).select("id", F.when(F.col("id") % 10 < 9, "big").when(F.col("id") % 20 == 9, "small").otherwise(None).alias("b"), curate.hash_order(1, F.col("id") % 5000).alias("h"))
    quotas = spark.createDataFrame([("big", 2345), ("small", 10_000), ("none", 5)], "b string, quota int")
    got = sampling.chosen_per(t, quotas, "b", "h", "id").collect()
    assert len(got) == 6000 and len({r.id for r in got}) == 6000
    want = {r.id for r in sorted((r for r in t.collect() if r.b == "big"), key=lambda r: (r.h, r.id))[:2345]} | {r.id for r in t.where("b = 'small'").collect()}
    assert {r.id for r in got if r._chosen} == want
    zero = sampling.chosen_per(t, quotas.withColumn("quota", F.lit(0)), "b", "h", "id")
    assert zero.where("_chosen").count() == 0 and zero.count() == 6000


def test_short_items_by_automata(spark):
    docs = [(i, t) for i, t in enumerate(["ab cd", "xaby", None, "", "b c", "zz", "日本語 ab"])]
    items = ["ab", "b c", "本", "zz top", "q"]
    want = {i for i, t in docs if t is not None and any(x in t for x in items)}
    d = spark.createDataFrame(docs, "_id int, _text string")
    for most in (1 << 20, 70, 1):
        found = curate.holding(d, spark.createDataFrame([(x,) for x in items], "_item string"), most)
        assert {r._id for r in found.collect()} == want
    plan = curate.holding(d, spark.createDataFrame([(x,) for x in items], "_item string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert curate.holding(d, spark.createDataFrame([("",)], "_item string")).count() == 6
