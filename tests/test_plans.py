"""What the registered queries' plans must not contain, and what they must."""

import pytest

import __spark_entry__ as entry
from parcelflow.operators.predicates import sane_active
from parcelflow.plans import hubs
from parcelflow.queries.proxy import listings, table as load

STREAMED = {n for n in entry.queries() if n.startswith("stream_")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    assert entry.entry(spark).columns[0] == "id"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [
    "flagship_below_market", "cma_stats", "dup_band", "dup_fingerprint", "alert_matches", "rental_yield", "complex_compare",
    "hub_top_cards", "history_summary", "retention", "daily_gapfill", "dictionary_links", "seller_labels", "redirect_targets"])
def test_no_cross_or_nested_loop_join(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(load(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in text
    text = plan(listings(spark, sf).where(sane_active("sale")).groupBy("district").count())
    assert "l_comment" not in text and "o_totalprice" not in text and "l_linestatus" in text


def test_top_cards_prune_before_the_shuffle(spark, sf):
    text = plan(hubs.hub_cards(listings(spark, sf)))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_listing_cards_drop_removed_rows_before_parts_are_joined(spark, sf):
    text = entry.queries()["listing_cards"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    firsts = [line.split("Relation [")[1].split("#")[0] for line in text.splitlines() if "Relation [" in line]
    assert firsts[:2] == ["l_orderkey", "o_orderkey"]
    one, other = (listings(spark, sf, by_status=b) for b in (True, False))
    assert one.exceptAll(other).isEmpty() and one.count() == other.count()
