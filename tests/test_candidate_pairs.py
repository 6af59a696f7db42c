"""Pairs of claims are made at their smallest entity and not moved."""

from collections import defaultdict

from groundwork.operators import conflicts


def test_pairs_are_made_once_and_not_moved(spark):
    rows = [(i, [i % 3, 10, i % 3] if i % 2 else [i % 4], [i % 5, None]) for i in range(40)] + [(40, [], None), (7, [2], [9]), (41, [2], [9])]
    claims = spark.createDataFrame(rows, "id long, site_ids array<long>, strata_ids array<long>")
    at = defaultdict(set)
    for i, sites, strata in rows:
        for kind, some in (("site", sites), ("stratum", strata)):
            for e in some or ():
                if e is not None:
                    at[f"{kind}:{e}"].add(i)
    wanted: dict[tuple[int, int], str] = {}
    for e, ids in at.items():
        for a in ids:
            for b in ids:
                if a < b:
                    wanted[a, b] = min(e, wanted.get((a, b), e))
    found = conflicts.candidate_pairs(claims)
    assert sorted(tuple(r) for r in found.collect()) == sorted((a, b, e) for (a, b), e in wanted.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("Join")] and "Aggregate" not in plan[: plan.index("Join")]
