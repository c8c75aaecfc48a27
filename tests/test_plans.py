"""Plans of queries that read all words: what is made once, and what doesn't grow with levels, counts or lengths."""

from __future__ import annotations

import __spark_entry__  # noqa: F401  registers all queries
from glossmill.plans import registry

DATA = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_levels_are_counted_without_distinct_counts(spark):
    plan = plan_of(registry.QUERIES["coverage_by_level"](spark, DATA))
    assert "distinct" not in plan.lower() and plan.count("Expand") == 1


def test_causes_read_texts_once_beside_the_vocabulary(spark):
    plan = plan_of(registry.QUERIES["coverage_causes"](spark, DATA))
    assert plan.count("regexp_extract_all") == 1


def test_lemma_gap_takes_no_row_six_times(spark):
    assert "Expand" not in plan_of(registry.QUERIES["lemma_gap"](spark, DATA))


def test_filter_effect_makes_n_grams_once(spark):
    assert "Window" not in plan_of(registry.QUERIES["filter_effect"](spark, DATA))


def test_greedy_expressions_cut_only_what_begins_one(spark):
    plan = plan_of(registry.QUERIES["greedy_expressions"](spark, DATA))
    assert "LeftSemi" in plan and plan.index("substring_index(run") < plan.index("LeftSemi")


def test_hits_are_made_once_for_domination(spark):
    assert "Window" not in plan_of(registry.QUERIES["expression_prefix_domination"](spark, DATA))


def test_particle_verbs_put_together_only_shown_sentences(spark):
    assert "LeftSemi" in plan_of(registry.QUERIES["particle_verbs"](spark, DATA))


def test_sketched_levels_compare_without_distinct_counts(spark):
    assert "count(distinct" not in plan_of(registry.QUERIES["sketched_levels"](spark, DATA))


def test_tokens_look_for_words_once(spark):
    from glossmill.plans import standins

    plan = plan_of(standins.tokens(spark, DATA))
    assert plan.count("regexp_extract_all") == 1 and "RLIKE" not in plan


def test_expression_candidates_make_only_expressions_distinct(spark):
    plan = plan_of(registry.QUERIES["expression_candidates"](spark, DATA))
    assert plan.count("LeftSemi") == 2 and plan.index("Aggregate [lemma") < plan.index("LeftSemi")  # what is made distinct has met the keys
