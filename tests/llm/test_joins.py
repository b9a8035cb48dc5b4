"""Tables that grow with the input are never broadcast: compressed or exploded, they would pass for small ones."""

import pytest

from siftwell.llm import components, near_dedup
from siftwell.llm import spelling as S


@pytest.fixture
def plans(monkeypatch):
    """The physical plans of all tables that an operator writes, and of those given to it."""
    seen = []

    def see(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    def recording(real):
        return lambda df, what: real(see(df), what)

    for module in (components, near_dedup, S):
        monkeypatch.setattr(module, "materialise", recording(module.materialise))
    see.seen = seen
    return see


def no_broadcast(plans):
    joins = [line.strip() for plan in plans.seen for line in plan.split("\n") if "Join" in line]
    assert any("SortMergeJoin" in line for line in joins)
    # numbering rows joins one offset a partition
    assert [line for line in joins if "Broadcast" in line and "BroadcastHashJoin [_part#" not in line] == []


@pytest.mark.parametrize("operator", [near_dedup.near_duplicates, near_dedup.distinct_documents])
def test_near_duplicates_broadcast_nothing(spark, plans, operator):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"{text} {'x' * (i % 3)}") for i in range(12)] + [(1, "another text of one id that stands apart")], "doc_id long, text string")
    plans(operator(docs)).collect()
    no_broadcast(plans)


def test_spelling_broadcasts_nothing(spark, plans):
    text = " ".join(w for w, n in (("abcdefg", 300), ("abcdefgh", 50), ("abcdefgx", 8)) for _ in range(n))
    plans(S.spelling_forms(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    no_broadcast(plans)
