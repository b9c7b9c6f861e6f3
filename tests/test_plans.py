"""What the plans must look like: filters and columns reach the scan, groups are limited early, nothing is a product."""

import importlib
import re

import pytest

import __spark_entry__

QUERIES = {k: f for m in __spark_entry__.CORE for k, f in importlib.import_module(m).R.queries.items()}
#: A rule matches by substring, which no equi-join expresses; the rules are a short table.
BY_SUBSTRING = {"j02_targets_by_name"}
#: Make checkpoints while the plan is built, or have a constant input.
BUILT_IN_STEPS = set()


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - BUILT_IN_STEPS))
def test_no_products(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text
    if name not in BY_SUBSTRING:
        assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(QUERIES["f01_active"](spark, small))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(city,starograb\)", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert {c.split(":")[0] for c in schema.split(",")} == {"record_id", "date_start", "date_end", "city"}


def test_nested_columns_are_pruned(spark, small):
    text = plan(QUERIES["t03_venue_tokens"](spark, small))
    assert "analysis:struct<ticket_info:struct<venue_name:string>>" in text


@pytest.mark.parametrize("name", ["m06_signature", "j07_parking_k2", "m05_insert_ignore"])
def test_groups_are_limited_before_the_shuffle(spark, small, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, small))


def test_top_k_needs_no_full_sort(spark, small):
    assert "TakeOrderedAndProject" in plan(QUERIES["o03_top_sources"](spark, small))
