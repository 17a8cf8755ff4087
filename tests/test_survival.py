"""Product-limit clearance against a plain computation."""

import datetime as dt
import math
import random

from kerbwise.operators import impact, survival
from tests.helpers import raw


def _rows(seed):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(240):
        when = start + dt.timedelta(hours=r.randrange(24 * 20))
        cause = r.choice(["accident", "debris", "construction"])
        end = when + dt.timedelta(minutes=r.choice([r.randrange(1, 400), 150, 5000, -5, 0]))
        row = {"created_date": f"{when}+00", "event_cause": cause, "resolved_datetime": f"{end}+00"}
        kind = r.random()
        if kind < 0.2:
            row["resolved_datetime"] = None  # still open
        elif kind < 0.4:
            row |= {"resolved_datetime": None, "closed_datetime": f"{end}+00"}
        rows.append(row)
    return rows + [{"created_date": "2024-01-03 00:00:00+00", "event_cause": "open", "resolved_datetime": None}] * 3


def _want(enriched):
    rows = enriched.select("cause", "t_event", "dur_raw_min", "dur_trust_min").collect()
    latest, lives = max(r.t_event for r in rows), {}
    for r in rows:
        seen = r.dur_trust_min is not None
        minutes = r.dur_trust_min if seen else r.dur_raw_min
        if minutes is None:
            minutes = (latest - r.t_event).total_seconds() / 60
        if minutes > 0:
            lives.setdefault(r.cause, []).append((min(math.ceil(minutes - 1e-9), 1440), seen))
    curves = {}
    for cause, held in lives.items():
        share = 1.0
        for t in sorted({t for t, _ in held}):
            at_risk = sum(u >= t for u, _ in held)
            cleared = sum(u == t and seen for u, seen in held)
            share *= 1 - cleared / at_risk
            curves[cause, t] = (at_risk, cleared, sum(u == t and not seen for u, seen in held), share)
    return curves


def test_survival_equals_product_limit(spark):
    enriched = impact.enrich(raw(spark, _rows(4)))
    want = _want(enriched)
    got = {(r.cause, r.minute): r for r in survival.survival_curve(enriched).collect()}
    assert set(got) == set(want) and any(w[2] for w in want.values())
    for at, (at_risk, cleared, censored, share) in want.items():
        assert (got[at].at_risk, got[at].cleared, got[at].censored) == (at_risk, cleared, censored)
        assert abs(got[at].open_share - share) < 1e-6
    table = {r.cause: r for r in survival.clearance_survival(enriched).collect()}
    for cause, row in table.items():
        own = {t: w[3] for (c, t), w in want.items() if c == cause}
        assert row.p50_min == min((t for t, s in own.items() if s <= 0.5 + 1e-6), default=None)
        assert row.p90_min == min((t for t, s in own.items() if s <= 0.1 + 1e-6), default=None)
    assert (table["open"].n, table["open"].cleared, table["open"].p50_min, table["open"].censored_share) == (3, 0, None, 1.0)
    assert survival.clearance_survival(enriched.limit(0)).count() == 0
