"""Stages on empty tables, and switches of path that change no result."""

import pytest

from cardloom.llm import exact_dedup
from cardloom.llm.decontaminate import drop_contaminated
from cardloom.llm.exact_dedup import drop_exact_copies
from cardloom.llm.near_copies import drop_near_copies
from cardloom.llm.toxicity import drop_toxic


@pytest.mark.parametrize("stage", ["toxic", "exact", "near", "benchmark"])
def test_stages_on_an_empty_table(spark, no_docs, stage):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    left = {"toxic": lambda: drop_toxic(no_docs, labels), "exact": lambda: drop_exact_copies(no_docs), "near": lambda: drop_near_copies(no_docs), "benchmark": lambda: drop_contaminated(no_docs, items)}[stage]()
    assert left.columns == no_docs.columns and left.count() == 0


def test_exact_dedup_with_repeats_joined_instead_of_broadcast(spark, docs, odd, monkeypatch):
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    told = lambda: sorted(map(str, exact_dedup.exact_dedup(rows).select("doc_id", "keep_id", "group_size", "text_sha256").collect()))
    want = told()
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert told() == want
