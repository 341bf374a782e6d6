"""The queries over limits, which have no SQL, against a plain replay of all rows."""

from __future__ import annotations

import pytest

from cairn import catalog
from cairn.registry import Views
from cairn.streaming import limits

QUERIES = {
    "st_quota": ("requests", "tenant_id", "moment", "id", limits.quota(20, 86_400), None), "st_token_bucket": ("requests", "tenant_id", "moment", "id", limits.token_bucket(3, 1 / 3600), None),
    "st_provider_limiter": ("requests", "route", "moment", "id", limits.token_bucket(10, 1 / 600), None), "st_rate_window": ("requests", "tenant_id", "moment", "id", limits.quota(2, 3600), None),
    "st_cooldown": ("requests", "tenant_id", "moment", "id", limits.cooldown(300), None), "st_epoch_rotation": ("ring", "scope_id", "created_at", "id", limits.rotation(7 * 86_400, 2048), "payload_size"),
    "sec_tokens_for_host": ("requests", "route", "moment", "id", limits.token_bucket(5, 1 / 900), None), "sec_rate_allow": ("requests", "tenant_id", "moment", "id", limits.token_bucket(2, 1 / 1800), None),
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_limits_equal_a_plain_replay(spark, sf_dir, name):
    view, key, at, id_, step, size = QUERIES[name]
    states: dict = {}
    want = []
    for r in sorted(getattr(Views(spark, sf_dir), view).collect(), key=lambda r: (r[at], r[id_])):
        states[r[key]], verdict = step(states.get(r[key]), float(r[at]), float(r[size]) if size else 0.0)
        want.append((r[id_], r[key], verdict))
    got = [(r["id"], r["key"], r["verdict"]) for r in catalog.queries()[name](spark, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
