"""Documents meet the ids that stay without a broadcast."""

from docsluice.llm.set_join import one_of_each_group


def test_ids_that_stay_are_not_broadcast(docs, rows):
    kept = one_of_each_group(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert kept.where("doc_id is null").count() == sum(r[0] is None for r in rows)
