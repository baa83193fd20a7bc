"""Judge outputs: JSON repair, parsing, diagnosis, validation and label consistency, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfold.functions import text as tx

# The labels of the evidence judge.
ERROR_TYPES = ("correct_complete", "correct_weak_proof", "lucky_correct", "finalization_error", "valid_but_incomplete", "arithmetic_error", "algebraic_error", "invalid_assumption", "strategy_mismatch", "wrong_direction", "format_error", "no_meaningful_solution")
CORRECT = ("correct_complete", "correct_weak_proof", "lucky_correct")
GOOD_EXECUTION = ("arithmetic_error", "algebraic_error", "finalization_error", "valid_but_incomplete")
BAD_STRATEGY = ("wrong_direction", "invalid_assumption", "strategy_mismatch", "no_meaningful_solution")
WRONG_ONLY = ("finalization_error", "valid_but_incomplete", "arithmetic_error", "algebraic_error", "invalid_assumption", "wrong_direction", "no_meaningful_solution")

SCORES = ("step_validity", "proof_completeness", "strategy_compliance", "consistency")
EVIDENCE = ", ".join(f"{s} string" for s in (*SCORES, "error_type", "judge_confidence"))
PRIORS = "priors array<struct<rollout_id:int,suitability:int,reason:string,risk_flag:string>>"


def parse(c: Column, schema: str, keys: tuple[str, ...] = (), deep: bool = False) -> Column:
    """The first candidate of a text that parses (and has the keys), as a struct; null where none does.

    Text that is JSON as it stands, without a backslash that might be LaTeX, is settled in the JVM; only the rest is mended.
    """
    text = F.trim(c)
    read = lambda t: F.from_json(t, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    fine = lambda s: s.isNotNull() & s["_bad"].isNull()
    plain = F.coalesce(text.startswith("{") & ~F.contains(text, F.lit("\\")) & fine(read(text)), F.lit(False))
    mended = read(F.when(plain & (not keys), text).otherwise(tx.json_candidate(F.when(~plain | bool(keys), c), keys, deep)["value"]))
    return F.when(fine(mended), mended)


def diagnose(c: Column) -> Column:
    """Codes for why a text might not parse. The codes, in their order."""
    t = F.trim(F.coalesce(c, F.lit("")))
    has = lambda s: F.contains(t, F.lit(s))
    codes = [
        ("contains_code_block", has("```")),
        ("missing_open_brace", ~has("{")),
        ("missing_close_brace", ~has("}")),
        ("prefix_text_before_json", ~F.startswith(t, F.lit("{"))),
        ("suffix_text_after_json", ~F.endswith(t, F.lit("}"))),
        ("contains_smart_quotes", t.rlike("[“”’]")),
        ("likely_single_quotes_only", has("'") & ~has('"')),
        ("contains_backslashes", has("\\")),
    ]
    found = F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in codes]))
    return F.when(t == "", F.array(F.lit("empty_output"))).when(F.size(found) == 0, F.array(F.lit("json_decode_error"))).otherwise(found)


def coverage(ids: Column, n: Column) -> Column:
    """missing, duplicate and invalid ids of a prior list against 0..n-1."""
    wanted = F.sequence(F.lit(0), n - 1)
    seen = F.array_distinct(ids)
    return F.struct(F.array_except(wanted, seen).alias("missing"), F.array_sort(F.filter(seen, lambda x: F.size(F.filter(ids, lambda y: y == x)) > 1)).alias("duplicate"), F.array_sort(F.array_except(seen, wanted)).alias("invalid"))


def evidence_issues(e: Column) -> Column:
    """missing_key:* and invalid_error_type:* codes; parsed_json_not_object for null."""
    missing = [F.when(e[k].isNull(), F.lit(f"missing_key:{k}")) for k in (*SCORES, "error_type")]
    kind = F.trim(e["error_type"])
    bad = F.when(e["error_type"].isNotNull() & ~kind.isin(*ERROR_TYPES), F.concat(F.lit("invalid_error_type:"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("empty"))))
    gone = F.array_compact(F.array(*missing))
    return F.when(e.isNull(), F.array(F.lit("parsed_json_not_object"))).when(F.size(gone) > 0, gone).otherwise(F.array_compact(F.array(bad)))


def strict_evidence(e: Column, correct: Column) -> Column:
    """What is wrong with a judgment whose numbers must be whole and in range: the first of missing_keys, invalid_numeric_field, score_out_of_range,
    judge_confidence_out_of_range, invalid_error_type; else ok, or inconsistent where the label doesn't suit the answer. Fields are texts; the judgment is a
    column of the table, not an expression that calls Python."""
    wanted = (*SCORES, "error_type", "key_strength", "key_weakness", "critical_failure_step", "judge_confidence")
    scores = F.transform(F.array(*[e[s] for s in SCORES]), lambda c: F.transform(F.array(c.try_cast("double")), lambda x: F.when(F.abs(x) < float("inf"), F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))))[0])
    both = F.struct(scores.alias("scores"), F.exists(F.array(*[e[k] for k in wanted]), lambda c: c.isNull()).alias("gap"), e["judge_confidence"].try_cast("double").alias("sure"), e["error_type"].alias("kind"))

    def judged(x: Column) -> Column:
        return (
            F.when(x["gap"], "missing_keys")
            .when(F.exists(x["scores"], lambda c: c.isNull()) | x["sure"].isNull(), "invalid_numeric_field")
            .when(F.exists(x["scores"], lambda c: (c < 0) | (c > 4)), "score_out_of_range")
            .when((x["sure"] < 0) | (x["sure"] > 1), "judge_confidence_out_of_range")
            .when(~x["kind"].isin(*ERROR_TYPES), "invalid_error_type")
            .when(~F.coalesce(label_agrees(correct, x["kind"]), F.lit(False)), "inconsistent")
            .otherwise("ok")
        )

    return F.transform(F.array(both), judged)[0]


def mend_error_type(error_type: Column, correct: Column, lowest_score: Column) -> Column:
    """The flag that judges put instead of a label, by correctness."""
    label = F.when(correct >= 1, F.when(lowest_score >= 3, "correct_complete").otherwise("correct_weak_proof")).otherwise("finalization_error")
    return F.when(F.trim(error_type) == "deterministic_correctness_flag", label).otherwise(error_type)


def consistent(error_type: Column, correct: Column, step_validity: Column) -> tuple[Column, Column]:
    """(label, whether it was changed): labels of correct answers only on correct answers, and the other way round."""
    wrong = (correct == 0) & error_type.isin(*CORRECT)
    right = (correct == 1) & error_type.isin(*WRONG_ONLY)
    label = F.when(wrong, F.when(step_validity >= 2, "finalization_error").otherwise("wrong_direction")).when(right, "correct_weak_proof").otherwise(error_type)
    return label, F.coalesce(wrong | right, F.lit(False))


def fallback(parsed: Column, correct: Column) -> Column:
    """Conservative scores where nothing parsed."""
    base = F.when(correct == 1, F.struct(*[F.lit("2").alias(s) for s in SCORES], F.lit("correct_weak_proof").alias("error_type"), F.lit("0.0").alias("judge_confidence"))).otherwise(F.struct(*[F.lit("0").alias(s) for s in SCORES], F.lit("no_meaningful_solution").alias("error_type"), F.lit("0.0").alias("judge_confidence")))
    return F.coalesce(parsed, base)


def heuristic(correct: Column) -> Column:
    """Evidence from the answer's correctness alone. Fixed values."""
    side = lambda score, kind, strength, weakness: F.struct(*[F.lit(score).alias(s) for s in SCORES], F.lit(kind).alias("error_type"), F.lit(0.5).alias("judge_confidence"), F.lit(strength).alias("key_strength"), F.lit(weakness).alias("key_weakness"))
    right = side(2, "correct_weak_proof", "Deterministically correct final answer.", "Heuristic mode does not inspect reasoning semantics.")
    return F.when(correct == 1, right).otherwise(side(0, "no_meaningful_solution", "", "Deterministically incorrect final answer."))


def learned_or_teacher(parsed: Column, teacher: Column, mode: str = "teacher") -> Column:
    """A learned judgment; where it failed, the teacher's if all its scores are there and the mode says so; else none at all. Scores and error_type."""
    fields = lambda c: F.struct(*[c[s].cast("int").alias(s) for s in SCORES], F.coalesce(F.nullif(c["error_type"], F.lit("")), F.lit("format_error")).alias("error_type"))
    nothing = F.struct(*[F.lit(0).alias(s) for s in SCORES], F.lit("format_error").alias("error_type"))
    usable = F.lit(mode == "teacher") & teacher.isNotNull()
    for s in SCORES:
        usable = usable & teacher[s].isNotNull()
    return F.when(parsed.isNotNull(), fields(parsed)).when(usable, fields(teacher)).otherwise(nothing)


def learned_prior(parsed: Column, teacher: Column, mode: str = "teacher") -> Column:
    """A learned suitability; where it failed, the teacher's or 2."""
    return F.coalesce(parsed, teacher if mode == "teacher" else F.lit(None).cast("int"), F.lit(2))


def uniform_prior(n: Column) -> Column:
    """Priors of a group whose judge failed."""
    return F.struct(F.lit(0).alias("suitability"), (1.0 / n).alias("prior_probability"))


def label_agrees(correct: Column, error_type: Column) -> Column:
    """Correct labels on correct answers, others on wrong ones."""
    return ((correct == 1) & error_type.isin(*CORRECT)) | ((correct == 0) & ~error_type.isin(*CORRECT))


def chat_issue(messages: Column) -> Column:
    """The first thing wrong with a chat: empty, bad_role, blank_content, system_not_first, last_not_assistant, not_alternating; else ok."""
    body = F.filter(messages, lambda m: m["role"] != "system")
    turns = F.transform(body, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    late = F.exists(F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0))), lambda m: m["role"] == "system")
    return (
        F.when(F.size(messages) < 1, "empty")
        .when(~F.forall(messages, lambda m: m["role"].isin("system", "user", "assistant")), "bad_role")
        .when(F.exists(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == ""), "blank_content")
        .when(late, "system_not_first")
        .when(F.element_at(messages, -1)["role"] != "assistant", "last_not_assistant")
        .when(~F.forall(turns, lambda x: x), "not_alternating")
        .otherwise("ok")
    )


def training_ids(prompt: Column, answer: Column, most: int, pad: int) -> Column:
    """Prompt cut on the left, answer kept; input ids, attention mask and labels (-100 on prompt and padding), padded on the right to `most`."""
    a = F.slice(answer, 1, most)
    room = F.greatest(F.lit(most) - F.size(a), F.lit(0))
    p = F.when(F.size(prompt) > room, F.slice(prompt, F.size(prompt) - room + 1, room)).otherwise(prompt)
    rest = F.lit(most) - F.size(p) - F.size(a)
    ids = F.concat(p, a, F.array_repeat(F.lit(pad), rest))
    return F.struct(ids.alias("input_ids"), F.concat(F.array_repeat(F.lit(1), F.size(p) + F.size(a)), F.array_repeat(F.lit(0), rest)).alias("attention_mask"), F.concat(F.array_repeat(F.lit(-100), F.size(p)), a, F.array_repeat(F.lit(-100), rest)).alias("labels"))
