"""Every code of the gates, and every rule of the preference pairs, occurs on the fixture."""

import pytest
from pyspark.sql import functions as F

from tarnfold.operators import gates as gt
from tarnfold.operators import preferences as pf
from tarnfold.plans import registry


def found(spark, sf_dir, name, column):
    return {r[0] for r in registry.QUERIES[name](spark, sf_dir).select(column).distinct().collect()}


def test_drop_reasons_and_steps(spark, sf_dir):
    rows = registry.QUERIES["p11_drop_reasons"](spark, sf_dir).collect()
    assert {r.reason for r in rows if r.kind == "row"} == {n for n, _ in gt.drop_gate()}
    assert {r.reason for r in rows if r.kind == "group"} == {n for n, _ in gt.prior_drop_gate()}
    assert found(spark, sf_dir, "p12_funnel", "step") == {"kept", *[n for n, _ in gt.STEPS]}


@pytest.mark.parametrize("name", ["p7_row_issues", "p8_p10_group_gate"])
def test_issues(spark, sf_dir, name):
    gate = gt.evidence_gate(0.3) if name.startswith("p7") else gt.prior_group_gate(3)
    seen = {c for text in found(spark, sf_dir, name, "issues") for c in text.split(",") if c}
    assert seen == {n for n, _ in gate}


def test_styles(spark, sf_dir):
    rules = {r.style for r in pf.bends(F.lit(True))}
    for name in ("l11_simple_evidence_pairs", "l11_runtime_evidence_pairs"):
        seen = found(spark, sf_dir, name, "style")
        assert seen <= {*rules, "real_learned_mistake"}
        # a rollout of a conflicted group mostly has a tag of its own, which comes first
        assert {r for r in rules if not r.startswith("posterior_conflict")} | {"real_learned_mistake"} <= seen
    assert found(spark, sf_dir, "l11_runtime_prior_pairs", "rejected_style") == {pf.LOW[0], pf.HIGH[0], pf.POLAR[0], "real_learned_mistake"}
