"""Overlapping profiles: merged sums equal those of the filtered observations, and no zone is torn."""

import pytest

from freightspark.operators import economics
from freightspark.plans import pilots, registry
from freightspark.sources import standins as src


def test_merged_sums_equal_filtered_observations(spark, sf):
    obs = src.observations(spark, sf).cache()
    got = pilots.merged_economics(pilots.partial_states(obs), pilots.membership(spark, registry.PROFILES)).collect()
    assert {r.slice for r in got} <= {p.name for p in registry.PROFILES} and len({r.slice for r in got}) >= 5
    for p in registry.PROFILES:
        rows = economics.slice_filter(obs, list(p.origins) or None, p.region, **{f: list(getattr(p, f)) for f in pilots.FILTERS})
        want = {r.destination_fias: r for r in economics.destination_economics(rows, ["destination_region"]).collect()}
        own = {r.destination_fias: r for r in got if r.slice == p.name}
        assert own.keys() == want.keys()
        for k, r in own.items():
            assert (r.n_rows, r.trip_count, r.length_trips, r.price_trips, r.rate_trips, r.destination_name) == tuple(want[k][c] for c in ("n_rows", "trip_count", "length_trips", "price_trips", "rate_trips", "destination_name"))
            for c in ("weighted_route_length", "weighted_price", "weighted_rub_per_km"):
                assert r[c] == (None if want[k][c] is None else pytest.approx(want[k][c]))
    obs.unpersist()


def test_pilots(spark):
    sf = "/root/testdata/sf0.01"
    rows = pilots.pilots(src.observations(spark, sf), src.coordinates(spark, sf), registry.PROFILES).collect()
    done = [r for r in rows if r.status == "completed"]
    assert {r.profile for r in rows} == {p.name for p in registry.PROFILES} and len({r.profile for r in done}) >= 5
    assert all(r.violations == 0 for r in done) and {r.mode for r in done} == {"geography", "geo_cost", "bear_cost"}
    nowhere = [r for r in rows if r.profile == "nowhere"]
    assert [(r.status, r.points, r.mode) for r in nowhere] == [("insufficient_resolved_points", 0, None)]
    whole = {r.mode: r for r in done if r.profile == "all of 1"}
    assert whole["geography"].clusters >= 2 and whole["geography"].assigned <= whole["geography"].points
    with pytest.raises(ValueError):
        pilots.pilots(src.observations(spark, sf), src.coordinates(spark, sf), registry.PROFILES[:4])
    with pytest.raises(ValueError):
        pilots.membership(spark, [registry.PROFILES[0]] * 2)
