from collections import Counter

from tessergraph.plans import catalog, retrieve


def test_replay_scores_no_api_again(spark, small, monkeypatch):
    """The second run reads the first one's frontier: no query's API is scored twice, however often it is found."""
    seen, inner = Counter(), retrieve.frontier

    def counted(found, *rest):
        seen.update(tuple(r) for r in found.select("query_id", "api").collect())
        return inner(found, *rest)

    monkeypatch.setattr(retrieve, "frontier", counted)
    _, state, _ = catalog._replayed(spark, small)
    # APIs without any pair leave nothing to be known, and cost nothing when they are found again.
    held = {tuple(r) for r in state.frontier.select("query_id", "api").distinct().collect()}
    assert held and all(seen[x] == 1 for x in held)
