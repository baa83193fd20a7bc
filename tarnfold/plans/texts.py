"""Queries of text, JSON and math functions (X*, N*, M*): completions are composed from table columns, so that SQL knows the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold.functions import closest, ragged
from tarnfold.functions import judge as jd
from tarnfold.functions import text as tx
from tarnfold.operators.curate import normalised, spread
from tarnfold.plans.base import query, table
from tarnfold.plans.curation import NORM

K = "o_orderkey"


def orders(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "orders").select(F.col(K).alias("id"), (F.col(K) % 4).alias("m")))


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def ID() -> Column:  # noqa: N802
    return F.col("id")


@query("x1_x2_normalise", f"SELECT doc_id, {NORM} AS norm FROM documents")
def x1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalised(F.col("text")).alias("norm"))


@query("x1_nfkc", "SELECT o_orderkey AS id, 'fi ' || o_orderkey || ' A1' AS norm FROM orders")
def x1b(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("id", tx.nfkc(text("ﬁ ", ID(), " Ａ１")).alias("norm"))


@query("x3_x4_x5_worked_answers", "SELECT o_orderkey AS id, 'a ' || o_orderkey || E' b\\n\\nc\\n#### $1,' || (100 + o_orderkey % 900) || '.' AS cleaned, '1' || (100 + o_orderkey % 900) AS answer FROM orders")
def x3(spark: SparkSession, d: str) -> DataFrame:
    t = orders(spark, d).withColumn("t", text("a <<1+2=3>>", ID(), " b  \n\n\n\nc\n#### $1,", 100 + ID() % 900, "."))
    return t.select("id", tx.worked_clean(F.col("t")).alias("cleaned"), tx.plain_number(tx.hash_answer(F.col("t"))).alias("answer"))


def completion() -> Column:
    """By id mod 4: three full sections with a box, an answer section in plain text, a box alone, a bare bracket."""
    full = text("[Strategy]\nadd\n[Reasoning]\nstep ", ID(), "\n[Final Answer]\nThe answer is \\boxed{x_{", ID(), "}}.")
    return F.when(F.col("m") == 0, full).when(F.col("m") == 1, text("[Final Answer]\n$", ID(), "$")).when(F.col("m") == 2, text("so \\boxed{1} or \\boxed{", ID(), "} \\boxed{open")).otherwise(text("[Final Answer]\n\\["))


ANSWER = "CASE o_orderkey % 4 WHEN 0 THEN 'x_{' || o_orderkey || '}' WHEN 3 THEN '[Final Answer]' ELSE o_orderkey::VARCHAR END"


@query("x6_section", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'step ' || o_orderkey ELSE '' END AS reasoning FROM orders")
def x6(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("id", tx.section(completion(), "Reasoning", ("Final Answer",)).alias("reasoning"))


@query("x7_last_boxed", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'x_{' || o_orderkey || '}' WHEN 2 THEN o_orderkey::VARCHAR ELSE '' END AS boxed FROM orders")
def x7(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("id", tx.last_boxed(completion()).alias("boxed"))


@query("x9_x10_x11_x12_final_answer", f"SELECT o_orderkey AS id, {ANSWER} AS answer FROM orders")
def x12(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("id", tx.final_answer(completion()).alias("answer"))


@query("x13_section_record", f"SELECT o_orderkey AS id, o_orderkey % 4 = 0 AS strategy_section_present, o_orderkey % 4 = 0 AS reasoning_section_present, o_orderkey % 4 <> 2 AS final_answer_section_present, {ANSWER} AS parsed_final_answer, false AS suspicious_final_answer, o_orderkey % 4 = 0 AS exact_format_success FROM orders")
def x13(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("id", tx.sections(completion()).alias("s")).select("id", "s.*")


@query("x14_free_extraction", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || ' apples' WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN o_orderkey::VARCHAR ELSE '' END AS answer, CASE o_orderkey % 4 WHEN 0 THEN 'explicit_answer_phrase' WHEN 1 THEN 'gsm8k_hash_answer' WHEN 2 THEN 'last_equals_expression' ELSE 'empty_completion' END AS source FROM orders")
def x14(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("m") == 0, text("Therefore the answer is ", ID(), " apples")).when(F.col("m") == 1, text("work\n#### ", ID())).when(F.col("m") == 2, text("x + 1 = ", ID())).otherwise(" ")
    return orders(spark, d).select("id", tx.free_answer(t).alias("s")).select("id", "s.*")


@query("x14_all_candidates", """WITH t AS (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS v, CAST(o_orderkey + 1 AS VARCHAR) AS w FROM orders),
s AS (SELECT id, v, w, 'First the answer is ' || w || chr(10) || 'so \\boxed{' || v || '} or' || chr(10) || '#### ' || v AS text FROM t)
SELECT id, unnest(['gsm8k_hash_answer', 'boxed', 'explicit_answer_phrase']) AS source, unnest([1, 2, 3])::INT AS rank, unnest([v, v, w]) AS answer, unnest([strpos(text, '#### ') + 4, strpos(text, 'boxed{') + 5, strpos(text, 'answer is ') + 9])::INT AS place FROM s""")
def x14_all(spark: SparkSession, d: str) -> DataFrame:
    """Every place where a text says an answer, by a table function in a lateral join."""
    tx.register_functions(spark)
    t = text("First the answer is ", ID() + 1, "\nso \\boxed{", ID(), "} or\n#### ", ID())
    orders(spark, d).select("id", t.alias("text")).createOrReplaceTempView("worked_answers")
    got = spark.sql("SELECT id, c.source, c.rank, c.answer, c.place FROM worked_answers, LATERAL answer_candidates(text) c")
    return got.where(F.col("source").isin("gsm8k_hash_answer", "boxed", "explicit_answer_phrase"))


def shapes(by: int, *cases: str | Column) -> Column:
    """The case of an id modulo their number."""
    out = F.lit(None).cast("string")
    for k, c in reversed(list(enumerate(cases))):
        out = F.when(ID() % by == k, F.lit(c) if isinstance(c, str) else c).otherwise(out)
    return out


@query("x8_x15_x16_x18_normalise_answer", """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 10 AS m, CAST(o_orderkey AS VARCHAR) AS v FROM orders)
SELECT id, CASE m WHEN 0 THEN '(' || v || ')/(2)' WHEN 1 THEN v WHEN 2 THEN '2*pi' WHEN 3 THEN '101_2' WHEN 4 THEN v WHEN 5 THEN '((' || v || ')/(2))/(3)' WHEN 6 THEN v || '%' WHEN 7 THEN v || ',-1' WHEN 8 THEN '-' || v ELSE '(' || v || ',2]' END AS normalized,
  m = 1 AS stripped_units, m = 2 AS had_pi, m IN (0, 5) AS had_fraction, m = 3 AS had_base_notation, CASE WHEN m = 7 THEN v || ';-1' ELSE '' END AS items,
  round(CASE m WHEN 0 THEN id / 2.0 WHEN 1 THEN id::DOUBLE WHEN 2 THEN 2 * pi() WHEN 4 THEN id::DOUBLE WHEN 5 THEN id / 6.0 WHEN 8 THEN -id::DOUBLE END, 9) + 0.0 AS numeric_value FROM t""")
def x18(spark: SparkSession, d: str) -> DataFrame:
    given = shapes(10, text("\\boxed{\\dfrac{", ID(), "}{2}}"), text("$", ID(), " \\text{feet}$"), "2\\pi", "101 in base 2", text("The answer is ", ID(), "."), text("\\frac{\\frac{", ID(), "}{2}}{3}"), text(ID(), "\\%"), text("{", ID(), " , -1}"), text("−", ID()), text("\\left( ", ID(), " , 2 \\right]"))
    t = orders(spark, d).select("id", tx.normalise_answer(given).alias("s"))
    return t.select("id", "s.normalized", "s.stripped_units", "s.had_pi", "s.had_fraction", "s.had_base_notation", F.array_join(F.coalesce("s.comma_items", F.array().cast("array<string>")), ";").alias("items"), (F.round("s.numeric_value", 9) + 0.0).alias("numeric_value"))


@query("x17_x19_x20_verify", "SELECT o_orderkey AS id, o_orderkey % 10 NOT IN (3, 7, 9) AS correct, CASE o_orderkey % 10 WHEN 0 THEN 'fraction_decimal_match' WHEN 1 THEN 'comma_set_match' WHEN 2 THEN 'exact_string' WHEN 4 THEN 'unit_stripped_match' WHEN 5 THEN 'latex_pi_match' WHEN 6 THEN 'numeric_match' WHEN 8 THEN 'latex_pi_match' ELSE 'no_match' END AS verification_method FROM orders")
def x20(spark: SparkSession, d: str) -> DataFrame:
    pred = shapes(10, text("\\frac{", ID(), "}{2}"), text(ID(), ", -1"), text("$", ID(), "$"), text(ID() + 1), text(ID(), " apples"), text(ID(), "\\pi"), text(ID()), text("(", ID(), ", 1)"), text(ID(), "\\pi/2"), "")
    gold = shapes(10, text((ID() / 2).cast("decimal(20,1)")), text("-1,", ID()), text(ID()), text(ID()), text(ID()), text(ID(), "*pi"), text(ID(), ".0000001"), text("(1, ", ID(), ")"), text("0.5*pi*", ID()), "")
    return orders(spark, d).select("id", tx.verify(pred, gold, F.lit("Find all roots of p.")).alias("s")).select("id", "s.correct", "s.verification_method")


# Answers by composition: how it is introduced, how it is wrapped, what it is. Each id is one of 4 x 4 x 5 compositions.
LEADS = ["", "[Strategy]\nadd\n[Reasoning]\n= 12\n[Final Answer]\n", "work 3/4\n\nFinal answer: ", "First \\boxed{12}\nFINAL_ANSWER: "]
WRAPS = [("", ""), ("\\boxed{", "}"), ("$", "$."), ("the answer is $\\boxed{\\text{", "}}$")]


def composed(spark: SparkSession, d: str) -> DataFrame:
    k = lambda by, n: (F.floor(ID() / by) % n).cast("int")
    pick = lambda at, cases: F.element_at(F.array(*[F.lit(c) if isinstance(c, str) else c for c in cases]), at + 1)
    values = [ID().cast("string"), text("\\frac{", ID(), "}{4}"), text(ID(), " apples"), text("-", ID(), ".50"), text("2\\pi + ", ID())]
    lead, wrap, value = k(1, 4), k(4, 4), k(16, 5)
    whole = F.concat(pick(lead, LEADS), pick(wrap, [a for a, _ in WRAPS]), pick(value, values), pick(wrap, [b for _, b in WRAPS]))
    return spread(table(spark, d, "orders").select(F.col(K).alias("id"), whole.alias("text")))


@query("x12_x18_composed", """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 4 AS lead, (o_orderkey // 4) % 4 AS wrap, (o_orderkey // 16) % 5 AS v FROM orders),
f AS (SELECT *, lead = 3 AND wrap <> 1 AND wrap <> 3 AS other FROM t)
SELECT id, CASE WHEN other THEN '12' WHEN v = 0 THEN CAST(id AS VARCHAR) WHEN v = 1 THEN '(' || id || ')/(4)' WHEN v = 2 THEN CAST(id AS VARCHAR) WHEN v = 3 THEN '-' || id || '.50' ELSE '2*pi+' || id END AS normalized,
  round(CASE WHEN other THEN 12.0 WHEN v = 0 THEN id WHEN v = 1 THEN id / 4.0 WHEN v = 2 THEN id WHEN v = 3 THEN -(id + 0.5) ELSE 2 * pi() + id END::DOUBLE, 6) AS numeric, NOT other AND v = 2 AS stripped FROM f""")
def x12_composed(spark: SparkSession, d: str) -> DataFrame:
    """Final answer of a composed completion, in its normal form. A box anywhere comes before a caption."""
    t = composed(spark, d).select("id", tx.normalise_answer(tx.final_answer(F.col("text"))).alias("a"))
    return t.select("id", "a.normalized", F.round("a.numeric_value", 6).alias("numeric"), F.col("a.stripped_units").alias("stripped"))


@query("x21_near_misses", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'numerically_very_close' WHEN 1 THEN 'order_may_matter,same_collection_items' ELSE '' END AS reasons FROM orders")
def x21(spark: SparkSession, d: str) -> DataFrame:
    pred = F.when(F.col("m") == 0, "1.0005").when(F.col("m") == 1, "11,7").otherwise("abc")
    gold = F.when(F.col("m") == 0, "1").when(F.col("m") == 1, "7,11").otherwise("xyz")
    return orders(spark, d).select("id", F.array_join(tx.near_misses(pred, gold, F.lit("What is x?")), ",").alias("reasons"))


@query("x22_solution_answer", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN '' ELSE o_orderkey::VARCHAR END AS answer FROM orders")
def x22(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("m") == 0, text("thus \\boxed{", ID(), "}.")).when(F.col("m") == 3, "").otherwise(text("We see there are ", ID(), "."))
    return orders(spark, d).select("id", tx.solution_answer(F.lit("p"), s).alias("answer"))


@query("x23_reasoning_prefix", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN E'[Strategy]\\nadd\\n[Reasoning]\\nstep ' || o_orderkey WHEN 1 THEN E'[Final Answer]\\n$' || o_orderkey || '$' WHEN 2 THEN 'so \\boxed{1} or \\boxed{' || o_orderkey || '} \\boxed{open' ELSE E'[Final Answer]\\n\\\\[' END AS kept FROM orders")
def x23(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("id", tx.reasoning_prefix(completion()).alias("kept"))


@query("x24_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' #' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def x24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.slug(F.concat("p_name", F.lit(" #"), "p_brand")).alias("slug"))


# Families of strategies with their keywords; keywords of strategies.
FAMILIES = {
    "algebraic_transformation": ["algebra", "equation", "transform", "substitution", "rewrite", "simplify", "factor", "manipulation"],
    "modular_reasoning": ["mod", "modular", "number_theory", "residue", "divisibility", "remainder", "parity", "congruence", "cycle"],
    "counting_formula": ["count", "combinatorics", "probability", "inclusion", "exclusion", "binomial", "formula"],
    "case_analysis": ["case", "casework", "split", "partition", "scenario"],
    "direct_computation": ["direct", "compute", "calculation", "brute", "enumerate", "numeric"],
}
STRATEGIES = [("fermat", "fermat_little_theorem"), ("euler", "euler_theorem"), ("cycle|repeat every|period", "cycle_detection"), (r"modulo| mod |\\mod|congru", "modular_arithmetic"), ("brute force|direct computation|enumerat", "brute_force"), ("case analysis|case-by-case|split into cases", "case_analysis")]
SAYS = {"cycle": r"cycle|repeat every|period", "mod": r"modulo| mod |\\mod|congru", "brute": "brute force|direct computation|enumerat", "case": "case analysis|case-by-case|split into cases", "theory": "fermat|euler"}
WANTED = {"brute_force": SAYS["brute"], "modular_arithmetic": SAYS["mod"], "cycle_detection": SAYS["cycle"], "case_analysis": SAYS["case"]}
RIVALS = {"brute_force": "|".join(SAYS[k] for k in ("theory", "cycle", "mod")), "modular_arithmetic": "|".join(SAYS[k] for k in ("cycle", "brute")), "cycle_detection": "|".join(SAYS[k] for k in ("theory", "brute")), "case_analysis": "|".join(SAYS[k] for k in ("theory", "cycle", "mod"))}
TALK = "CASE o_orderkey % 4 WHEN 0 THEN 'Use Fermat and a cycle' WHEN 1 THEN 'work modulo 7' WHEN 2 THEN 'direct computation' ELSE 'guess' END"


def talk() -> Column:
    return F.when(F.col("m") == 0, "Use Fermat and a cycle").when(F.col("m") == 1, "work modulo 7").when(F.col("m") == 2, "direct computation").otherwise("guess")


@query("x25_keyword_classes", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'fermat_little_theorem / cycle_detection' WHEN 1 THEN 'modular_arithmetic' WHEN 2 THEN 'brute_force' ELSE 'unknown' END AS strategies, CASE o_orderkey % 4 WHEN 0 THEN 'fermat_little_theorem' WHEN 1 THEN 'modular_arithmetic' WHEN 2 THEN 'brute_force' ELSE 'other' END AS first_strategy FROM orders")
def x25(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("id", tx.all_classes(talk(), STRATEGIES).alias("strategies"), tx.first_class(talk(), STRATEGIES, "other").alias("first_strategy"))


@query("x25_closest_name")
def x25_closest(spark: SparkSession, d: str) -> DataFrame:
    """The nation whose name is closest to each distinct word of the benchmark's texts. No SQL: held against a comparison with all names in the tests."""
    names = [r[0] for r in table(spark, d, "nation").select("n_name").collect()]  # a list of names is a parameter
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.upper("text"), r"\s+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", closest.closest_name(F.col("word"), names).alias("nation"))


@query("x25_strategy_family", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'modular_reasoning' WHEN 1 THEN 'counting_formula' WHEN 2 THEN 'case_analysis' ELSE 'direct_computation' END AS family FROM orders""")
def x25_family(spark: SparkSession, d: str) -> DataFrame:
    """By own name, by a keyword, by the description's keyword, by closeness."""
    raw = F.when(F.col("m") == 0, "Modular Reasoning").when(F.col("m") == 1, text("binomial ", ID())).when(F.col("m") == 2, text("z", ID())).otherwise("dirct_comptation")
    told = F.when(F.col("m") == 2, "Split by sign").otherwise("")
    return orders(spark, d).select("id", closest.strategy_family(raw, told, list(FAMILIES), FAMILIES).alias("family"))


@query("x26_compliance", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 1 THEN 1.0 WHEN 3 THEN 0.3 ELSE 0.0 END::DOUBLE AS score FROM orders")
def x26(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("id", F.round(tx.compliance(talk(), F.lit("modular_arithmetic"), WANTED, RIVALS), 6).alias("score"))


@query("x27_n11_prompts", "SELECT item_id, '[{\"role\":\"system\",\"content\":\"Solve.\"},{\"role\":\"user\",\"content\":\"Problem ' || item_id || '\"},{\"role\":\"assistant\",\"content\":\"n=' || length(text) || '\"}]' AS messages FROM benchmark")
def x27(spark: SparkSession, d: str) -> DataFrame:
    m = F.array(tx.message("system", F.lit("Solve.")), tx.message("user", F.format_string("Problem %d", "item_id")), tx.message("assistant", F.format_string("n=%d", F.length("text"))))
    return table(spark, d, "benchmark").select("item_id", F.to_json(m).alias("messages"))


@query("x28_stable_id", "SELECT n_nationkey, sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}') AS example_id FROM nation")
def x28(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", tx.stable_id(F.col("n_nationkey"), F.col("n_name")).alias("example_id"))


@query("x29_last_assistant", "SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS content FROM conversations GROUP BY 1")
def x29(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return t.select("conv_id", tx.last_assistant(F.col("m")).alias("content"))


@query("x30_formats", """SELECT lang, format('{:.2f}', avg(quality) * 100) || '% (n=' || count(*) || ')' AS shown, format('{:.2f}', avg(quality) * 100) || ' ± ' || format('{:.2f}', coalesce(stddev_pop(quality), 0) * 100) || '% (n=' || count(*) || ')' AS spread,
  replace(CAST(round(count(*) / 8.0, 3)::DECIMAL(18, 3)::DOUBLE AS VARCHAR), '.', 'p') AS slug FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def x30(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("q"), F.stddev_pop("quality").alias("s"), F.count("*").alias("n"))
    slug = tx.parameter_slug(F.round(F.col("n") / 8, 3))
    return t.select("lang", tx.percent(F.col("q"), F.col("n")).alias("shown"), tx.percent(F.col("q"), F.col("n"), F.coalesce("s", F.lit(0.0))).alias("spread"), F.when(F.contains(slug, F.lit("p")), slug).otherwise(F.concat(slug, F.lit("p0"))).alias("slug"))


# JSON


def judged() -> Column:
    """By id mod 4: fenced JSON with a trailing comma, plain JSON, prose, empty."""
    body = text('{"step_validity": ', ID() % 5, ', "proof_completeness": "3", "strategy_compliance": 2, "consistency": 9, "error_type": "arithmetic_error", "judge_confidence": 0.5')
    return F.when(F.col("m") == 0, F.concat(F.lit("Sure: ```json\n"), body, F.lit(",}\n```"))).when(F.col("m") == 1, F.concat(body, F.lit("}"))).when(F.col("m") == 2, "no idea").otherwise("")


@query("n1_n3_n6_repair_parse", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_orderkey % 5 AS INT) END AS step_validity, CASE WHEN o_orderkey % 4 < 2 THEN 4 END AS consistency, CASE WHEN o_orderkey % 4 < 2 THEN '' ELSE 'parsed_json_not_object' END AS issues FROM orders")
def n1(spark: SparkSession, d: str) -> DataFrame:
    from tarnfold.functions.coerce import score_0_to_4

    t = orders(spark, d).withColumn("e", jd.parse(judged(), jd.EVIDENCE))
    ok = F.col("e").isNotNull()
    return t.select("id", F.when(ok, score_0_to_4(F.col("e.step_validity"))).alias("step_validity"), F.when(ok, score_0_to_4(F.col("e.consistency"))).alias("consistency"), F.array_join(jd.evidence_issues(F.col("e")), ",").alias("issues"))


@query("n2_latex_json", """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '\\frac{' || o_orderkey || '}{2}' WHEN 1 THEN 'a' || chr(10) || '\\binom{5}{' || o_orderkey || '}' WHEN 2 THEN 'A\\u12 \\(' || o_orderkey WHEN 3 THEN '"\\text ' || o_orderkey || ',]' ELSE '\\\\right' END AS reason FROM orders""".replace("\\\\", "\\"))
def n2(spark: SparkSession, d: str) -> DataFrame:
    """Commands whose backslash JSON would take for an escape, escapes that are meant, codes whole and cut short."""
    t = shapes(5, text('{"reason": "\\frac{', ID(), '}{2}"}'), text('{"reason": "a\\n\\binom{5}{', ID(), '}"}'), text('{"reason": "\\u0041\\u12 \\(', ID(), '"}'), text('{"reason": "\\"\\text ', ID(), ',]"}'), text('{"reason": "\\\\right"}'))
    return orders(spark, d).select("id", F.get_json_object(tx.latex_safe_json(t), "$.reason").alias("reason"))


@query("n3_cascade", """WITH t AS (SELECT o_orderkey AS id, o_orderkey % 6 AS m, CAST(o_orderkey AS VARCHAR) AS v FROM orders)
SELECT id, CASE m WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN v WHEN 4 THEN '7' END AS a, CASE m WHEN 0 THEN 'repaired' WHEN 1 THEN 'repaired' WHEN 2 THEN 'object' WHEN 3 THEN 'object' WHEN 4 THEN 'repaired' ELSE 'none' END AS source FROM t""")
def n3(spark: SparkSession, d: str) -> DataFrame:
    """Fenced with commas left over; quotes of print; two objects, of which one fits; an object after one that never closes; nested in prose; nothing that fits."""
    t = shapes(
        6,
        text('Sure:\n```json\n{"a": ', ID(), ', "b": [1, 2,],}\n```'),
        text("{“a”: ", ID(), "} done"),
        text('{"b": 1} and {"a": ', ID(), ',}'),
        text('{"x": [1 {"b": 2} so {"a": ', ID(), "} }"),
        text('result {"a": 7, "c": {"d": "\\sqrt{2}, }"}} end ', ID()),
        text('{"b": ', ID(), "}"),
    )
    got = tx.json_candidate(t, ("a",), True)
    return orders(spark, d).select("id", got.alias("c")).select("id", F.get_json_object("c.value", "$.a").alias("a"), "c.source")


@query("n6_strict_ranges", """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing_keys' WHEN 2 THEN 'invalid_numeric_field' WHEN 3 THEN 'score_out_of_range' WHEN 4 THEN 'judge_confidence_out_of_range' WHEN 5 THEN 'invalid_error_type' ELSE 'inconsistent' END AS verdict FROM orders""")
def n6(spark: SparkSession, d: str) -> DataFrame:
    """A judgment per kind of fault."""
    body = lambda score, confidence, kind: text('{"step_validity": ', score, ', "proof_completeness": "3", "strategy_compliance": 2, "consistency": 0, "error_type": "', kind, '", "key_strength": "", "key_weakness": "", "critical_failure_step": "', ID(), '", "judge_confidence": ', confidence, "}")
    t = shapes(7, body("4", "1.0", "lucky_correct"), text('{"step_validity": 1}'), body('"x"', "0.5", "lucky_correct"), body("5", "0.5", "lucky_correct"), body("1", "1.5", "lucky_correct"), body("1", "0.5", "typo"), body("1", "0.5", "arithmetic_error"))
    schema = jd.EVIDENCE + ", key_strength string, key_weakness string, critical_failure_step string"
    return orders(spark, d).select("id", jd.parse(t, schema).alias("e")).select("id", jd.strict_evidence(F.col("e"), F.lit(1)).alias("verdict"))


@query("n4_diagnosis", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'contains_code_block,prefix_text_before_json,suffix_text_after_json' WHEN 1 THEN 'json_decode_error' WHEN 2 THEN 'missing_open_brace,missing_close_brace,prefix_text_before_json,suffix_text_after_json' ELSE 'empty_output' END AS codes FROM orders")
def n4(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("id", F.array_join(jd.diagnose(judged()), ",").alias("codes"))


@query("n5_prior_coverage", "SELECT o_orderkey AS id, '2' AS missing, '1' AS duplicate, CAST(5 + o_orderkey % 4 AS VARCHAR) AS invalid FROM orders")
def n5(spark: SparkSession, d: str) -> DataFrame:
    raw = text('{"priors": [{"rollout_id": 0, "suitability": 3}, {"rollout_id": 1}, {"rollout_id": 1}, {"rollout_id": ', 5 + F.col("m"), "}]}")
    ids = F.transform("p.priors", lambda p: p["rollout_id"])
    t = orders(spark, d).select("id", jd.parse(raw, jd.PRIORS).alias("p")).select("id", jd.coverage(ids, F.lit(3)).alias("c"))
    return t.select("id", *[F.array_join(F.transform(F.col(f"c.{k}"), lambda x: x.cast("string")), ",").alias(k) for k in ("missing", "duplicate", "invalid")])


CASES = "CASE o_orderkey % 4 WHEN 0 THEN 'correct_complete' WHEN 1 THEN 'arithmetic_error' WHEN 2 THEN 'deterministic_correctness_flag' ELSE 'format_error' END"


@query("n7_n8_label_consistency", f"""WITH t AS (SELECT o_orderkey AS id, {CASES} AS e, (o_orderkey // 4) % 2 AS c, (o_orderkey // 8) % 5 AS s FROM orders),
m AS (SELECT *, CASE WHEN e = 'deterministic_correctness_flag' THEN CASE WHEN c = 1 THEN CASE WHEN s >= 3 THEN 'correct_complete' ELSE 'correct_weak_proof' END ELSE 'finalization_error' END ELSE e END AS e2 FROM t)
SELECT id, CASE WHEN c = 0 AND e2 LIKE 'correct%' THEN CASE WHEN s >= 2 THEN 'finalization_error' ELSE 'wrong_direction' END WHEN c = 1 AND e2 IN ('arithmetic_error', 'finalization_error') THEN 'correct_weak_proof' ELSE e2 END AS label,
  (c = 0 AND e2 LIKE 'correct%') OR (c = 1 AND e2 IN ('arithmetic_error', 'finalization_error')) AS changed FROM m""")
def n7(spark: SparkSession, d: str) -> DataFrame:
    e = F.when(F.col("m") == 0, "correct_complete").when(F.col("m") == 1, "arithmetic_error").when(F.col("m") == 2, "deterministic_correctness_flag").otherwise("format_error")
    c, s = F.floor(ID() / 4) % 2, F.floor(ID() / 8) % 5
    t = orders(spark, d).withColumns({"c": c, "s": s}).withColumn("e", jd.mend_error_type(e, F.col("c"), F.col("s")))
    label, changed = jd.consistent(F.col("e"), F.col("c"), F.col("s"))
    return t.select("id", label.alias("label"), changed.alias("changed"))


@query("n9_fallback", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN 'arithmetic_error' WHEN o_orderkey % 2 = 1 THEN 'correct_weak_proof' ELSE 'no_meaningful_solution' END AS conservative,
  CASE WHEN o_orderkey % 2 = 1 THEN 'correct_weak_proof:2:0.5' ELSE 'no_meaningful_solution:0:0.5' END AS heuristic, CASE WHEN o_orderkey % 4 < 2 THEN 'arithmetic_error' WHEN o_orderkey % 5 > 1 THEN 'invalid_assumption' ELSE 'format_error' END AS teacher,
  CASE WHEN o_orderkey % 4 < 2 THEN 'arithmetic_error' ELSE 'format_error' END AS zero, CAST(CASE WHEN o_orderkey % 4 < 2 THEN 1 WHEN o_orderkey % 5 > 0 THEN 3 ELSE 2 END AS INT) AS prior, 1.0::DOUBLE / (1 + o_orderkey % 7) AS uniform FROM orders""")
def n9(spark: SparkSession, d: str) -> DataFrame:
    """All fallbacks, of judgments of which half don't parse; the teacher's lack for some, or lack a score."""
    fields = [*jd.SCORES, "error_type", "judge_confidence"]
    t = orders(spark, d).withColumn("e", jd.parse(judged(), jd.EVIDENCE))
    parsed = F.when(F.col("e").isNotNull(), F.struct(*[F.col(f"e.{f}").alias(f) for f in fields]))
    teacher = F.when(ID() % 5 > 0, F.struct(*[F.when(ID() % 5 > 1, 3).alias(s) for s in jd.SCORES], F.lit("invalid_assumption").alias("error_type")))
    h = jd.heuristic(ID() % 2)
    return t.select(
        "id",
        jd.fallback(parsed, ID() % 2)["error_type"].alias("conservative"),
        F.concat_ws(":", h["error_type"], h["consistency"], h["judge_confidence"]).alias("heuristic"),
        jd.learned_or_teacher(F.col("e"), teacher)["error_type"].alias("teacher"),
        jd.learned_or_teacher(F.col("e"), teacher, "zero")["error_type"].alias("zero"),
        jd.learned_prior(F.when(F.col("e").isNotNull(), 1), F.when(ID() % 5 > 0, 3)).alias("prior"),
        jd.uniform_prior(1 + ID() % 7)["prior_probability"].alias("uniform"),
    )


@query("n10_chat_issues", """WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS r, bool_or(trim(coalesce(text, '')) = '') AS blank, list(role ORDER BY turn) FILTER (role <> 'system') AS b FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN blank THEN 'blank_content' WHEN len(list_filter(r[2:], lambda x: x = 'system')) > 0 THEN 'system_not_first' WHEN r[len(r)] <> 'assistant' THEN 'last_not_assistant'
  WHEN len(list_filter(range(1, len(b) + 1), lambda i: b[i] <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) > 0 THEN 'not_alternating' ELSE 'ok' END AS issue FROM c""")
def n10(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return t.select("conv_id", jd.chat_issue(F.col("m")).alias("issue"))


@query("n12_training_ids", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN '2 3 4 5 6 7 8 9' ELSE repeat('1 ', CAST(o_orderkey % 4 AS INT)) || '8 9' || repeat(' 0', CAST(6 - o_orderkey % 4 AS INT)) END AS input_ids, CASE WHEN o_orderkey % 4 = 3 THEN 2 ELSE 2 END AS n_labels FROM orders")
def n12(spark: SparkSession, d: str) -> DataFrame:
    prompt = F.when(F.col("m") == 3, F.sequence(F.lit(1), F.lit(7))).otherwise(F.array_repeat(F.lit(1), F.col("m").cast("int")))
    t = orders(spark, d).select("id", jd.training_ids(prompt, F.array(F.lit(8), F.lit(9)), 8, 0).alias("s"))
    return t.select("id", F.array_join(F.transform("s.input_ids", lambda x: x.cast("string")), " ").alias("input_ids"), F.size(F.filter("s.labels", lambda x: x != -100)).alias("n_labels"))


@query("m1_m2_safe_arithmetic", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey + 1) / 2.0 WHEN 1 THEN pow(o_orderkey % 10, 2) WHEN 2 THEN NULL ELSE -pi() END::DOUBLE AS v FROM orders")
def m1(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("m") == 0, text("(", ID(), "+1)/2")).when(F.col("m") == 1, text(ID() % 10, "^2")).when(F.col("m") == 2, "9^9^9^9").otherwise("-pi")
    return orders(spark, d).select("id", tx.evaluate(t).alias("v"))


@query("m4_vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def m4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 6).alias("norm"))


#: An embedding as eight token vectors; every third token of a row is masked, and all of a row in fifty.
TOKENS = "SELECT vec_id, t, list_transform(embedding[8 * t + 1:8 * t + 8], lambda x: x::DOUBLE) AS v, CASE WHEN (vec_id + t) % 3 = 0 OR vec_id % 50 = 0 THEN 0 ELSE 1 END AS m FROM embeddings, range(0, 8) r(t)"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    each = F.sequence(F.lit(0), F.lit(7))
    on = F.transform(each, lambda t: F.when(((F.col("vec_id") + t) % 3 == 0) | (F.col("vec_id") % 50 == 0), 0).otherwise(1))
    return table(spark, d, "embeddings").select("vec_id", F.transform(each, lambda t: F.slice("embedding", 8 * t + 1, 8)).alias("vectors"), on.alias("mask"))


@query("m4_masked_pooling", f"""WITH t AS ({TOKENS}), c AS (SELECT vec_id, k, coalesce(sum(v[k] * m), 0) / greatest(sum(m), 1) AS x FROM t, range(1, 9) g(k) GROUP BY 1, 2)
SELECT vec_id, CAST(k - 1 AS INT) AS component, round(x / CASE WHEN n > 0 THEN n ELSE 1 END, 6) AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS n FROM c)""")
def m4_pool(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).select("vec_id", F.posexplode(ragged.pool("vectors", "mask")).alias("component", "x")).select("vec_id", "component", F.round("x", 6).alias("x"))


@query("w15_token_rewards", f"""WITH t AS (SELECT vec_id, sum(-abs(v[1]) * m) AS total, sum(m) AS n FROM ({TOKENS}) GROUP BY 1)
SELECT vec_id, n::BIGINT AS tokens, {", ".join(f"round(CASE WHEN n > 0 THEN {x} ELSE 0 END, 9) AS {name}" for name, x in (("sum_exp", "exp(greatest(least(total, 0), -80))"), ("mean_exp", "exp(greatest(least(total / n, 0), -80))"), ("sum", "total"), ("mean", "total / n")))} FROM t""")
def w15_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Rewards of answers from the log probabilities of their tokens, those under the mask only."""
    logps = F.transform("vectors", lambda v: -F.abs(v[0].cast("double")))
    t = tokens(spark, d)
    rewards = [F.round(ragged.logp_reward(logps, F.col("mask"), mode), 9).alias(mode) for mode in ("sum_exp", "mean_exp", "sum", "mean")]
    return t.select("vec_id", ragged.token_sums(logps, F.col("mask"))["tokens"].alias("tokens"), *rewards)


@query("m5_process_reward", "SELECT event_id, round(CASE WHEN event_type = 'click' THEN 0.7 + 0.3 * value / 100 ELSE 0.1 * value / 100 END, 9) AS reward FROM events")
def m5(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("value") / 100
    return table(spark, d, "events").select("event_id", F.round(F.when(F.col("event_type") == "click", 0.7 + 0.3 * p).otherwise(0.1 * p), 9).alias("reward"))


@query("m6_weight_maps", "WITH w AS (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS family, sum(value) AS w FROM events GROUP BY 1, 2) SELECT user_id, family, round(w / sum(w) OVER (PARTITION BY user_id), 7) AS weight FROM w")
def m6(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    fam = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other")
    w = table(spark, d, "events").groupBy("user_id", fam.alias("family")).agg(F.sum("value").alias("w"))
    return w.select("user_id", "family", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("user_id")), 7).alias("weight"))
