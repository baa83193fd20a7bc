"""Text functions as columns: built-ins where the rule is regular, Arrow-batched pandas UDFs where it isn't."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions import answers as a
from tarnfold.functions import jsonmend


def _struct(fn: Callable, schema: str, *cols: Column) -> Column:
    """fn of a row's texts -> a tuple of the schema's fields, over Arrow batches."""
    return _udf(fn, schema, [f.split()[0] for f in schema.split(", ")])(*cols)


def _udf(fn: Callable, schema: str, names: list[str] | None):  # noqa: ANN202
    def rows(it):  # noqa: ANN001, ANN202
        for got in it:
            series = got if isinstance(got, tuple) else (got,)
            columns = [x.astype(object).where(x.notna(), None).tolist() for x in series]
            known = {row: fn(*row) for row in set(zip(*columns, strict=True))}  # equal rows are computed once
            values = [known[row] for row in zip(*columns, strict=True)]
            yield pd.DataFrame(values, columns=names) if names else pd.Series(values, dtype=object)

    rows.__annotations__ = {"it": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame if names else pd.Series]}
    return F.pandas_udf(rows, schema)


def nfkc(c: Column) -> Column:
    return _udf(lambda s: None if s is None else unicodedata.normalize("NFKC", s), "string", None)(c)


def last_boxed(c: Column) -> Column:
    return _udf(a.last_boxed, "string", None)(c)


def final_answer(c: Column) -> Column:
    return _udf(a.final_answer, "string", None)(c)


def sections(c: Column) -> Column:
    return _struct(a.sections, "strategy_section_present boolean, reasoning_section_present boolean, final_answer_section_present boolean, parsed_final_answer string, suspicious_final_answer boolean, exact_format_success boolean", c)


def free_answer(c: Column) -> Column:
    return _struct(a.free_answer, "answer string, source string", c)


def normalise_answer(c: Column) -> Column:
    return _struct(a.normalise, "raw string, normalized string, stripped_units boolean, had_pi boolean, had_fraction boolean, had_base_notation boolean, comma_items array<string>, numeric_value double", c)


def verify(predicted: Column, gold: Column, problem: Column) -> Column:
    return _struct(lambda p, g, q: a.verify(p, g, q or ""), "normalized_predicted_answer string, normalized_gold_answer string, correct boolean, verification_method string", predicted, gold, problem)


def near_misses(predicted: Column, gold: Column, problem: Column) -> Column:
    return _udf(lambda p, g, q: a.near_misses(p, g, q or ""), "array<string>", None)(predicted, gold, problem)


def evaluate(c: Column) -> Column:
    return _udf(lambda s: None if s is None else a.evaluate(s), "double", None)(c)


def solution_answer(problem: Column, solution: Column) -> Column:
    return _udf(a.solution_answer, "string", None)(problem, solution)


def latex_safe_json(c: Column) -> Column:
    """JSON text whose strings hold LaTeX, as JSON that keeps it."""
    return _udf(lambda s: None if s is None else jsonmend.mend(s).text, "string", None)(c)


def json_candidate(c: Column, keys: tuple[str, ...] = (), deep: bool = False) -> Column:
    """struct<value, source>: the first candidate of a text that parses (and has the keys), as JSON; where it came from."""
    return _struct(lambda s: jsonmend.parse(s, keys, deep), "value string, source string", c)


@F.udtf(returnType="rank int, answer string, source string, place int, last boolean", useArrow=False)
class AnswerCandidates:
    """Every answer that a text may give, the one to take first: FROM t, LATERAL answer_candidates(text)."""

    def eval(self, text: str) -> Iterator[tuple]:
        for rank, candidate in enumerate(a.free_answers(text), 1):
            yield rank, *candidate


def register_functions(spark: SparkSession) -> None:
    """Table functions for SQL."""
    spark.udtf.register("answer_candidates", AnswerCandidates)


# Regular rules, in the JVM.


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def worked_clean(c: Column) -> Column:
    """Worked solutions: calculator marks, spaces at line ends and runs of blank lines go."""
    t = F.regexp_replace(c, r"<<[^>]*>>", "")
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def hash_answer(c: Column) -> Column:
    """What follows the last `####`, else the last line that isn't blank."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    return F.trim(F.when(F.contains(c, F.lit("####")), F.substring_index(c, "####", -1)).otherwise(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))))


def plain_number(c: Column) -> Column:
    """Without $, thousands' commas, a lead-in phrase and a full stop."""
    t = F.regexp_replace(F.trim(c), r"(?i)^(?:the answer is|answer:)\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[$,]", ""), r"\.+$", ""))


def section(c: Column, name: str, following: tuple[str, ...] = ()) -> Column:
    stop = r"(?=\n\s*\[(?:" + "|".join(following) + r")\]|\z)" if following else r"\z"
    return F.trim(F.regexp_extract(c, rf"(?is)\[{name}\]\s*(.*{'?' if following else ''}){stop}", 1))


def suspicious(c: Column) -> Column:
    core = F.regexp_replace(c, r"[\s.,;:!?$`]+", "")
    return (core == "") | core.rlike(r"^[\\\[\](){}]+\z")


def reasoning_prefix(c: Column) -> Column:
    """Reasoning without the generated final answer."""
    return F.rtrim(F.regexp_extract(c, r"(?is)^(.*?)(?=\n\s*\[Final Answer\]|\bFINAL_ANSWER:|\z)", 1))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def first_class(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The class of the first pattern found."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def all_classes(c: Column, rules: list[tuple[str, str]], default: str = "unknown") -> Column:
    """All classes whose pattern is found, joined by ` / `."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hit = F.array_join(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for p, n in rules])), " / ")
    return F.when(hit == "", default).otherwise(hit)


def compliance(c: Column, assigned: Column, wanted: dict[str, str], against: dict[str, str]) -> Column:
    """0.7 if the assigned strategy's words occur, 0.3 if none of its rivals' do."""
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit(0.0)
    for name in wanted:
        score = F.when(low.rlike(wanted[name]), 0.7).otherwise(0.0) + F.when(~low.rlike(against[name]), 0.3).otherwise(0.0)
        out = F.when(assigned == name, score).otherwise(out)
    return out


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def last_assistant(messages: Column) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))["content"]


def stable_id(*cols: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def percent(mean: Column, n: Column, deviation: Column | None = None) -> Column:
    """`61.25% (n=4)`, or with a deviation `61.25 ± 0.40% (n=4)`."""
    shown = F.format_number(mean * 100, 2)
    if deviation is not None:
        shown = F.concat(shown, F.lit(" ± "), F.format_number(deviation * 100, 2))
    return F.concat(shown, F.lit("% (n="), n.cast("string"), F.lit(")"))


def parameter_slug(value: Column) -> Column:
    """A number as part of a file name: 0.5 is 0p5, -1 is m1; whole numbers without a fraction."""
    shown = F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"\.?0+$", "")
    return F.replace(F.replace(shown, F.lit("-"), F.lit("m")), F.lit("."), F.lit("p"))
