"""The clearance forest of a log is fitted once for the table by cause and the errors, also when both are made at the same time."""

import datetime as dt
import gc

from kerbwise.operators import impact, models
from kerbwise.session import together
from tests.helpers import raw


def test_one_forest_for_table_and_errors(spark, monkeypatch):
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        when = start + dt.timedelta(hours=6 * i)
        end = when + dt.timedelta(minutes=(20 if i % 2 else 200) + i * 7 % 30)
        rows.append({"created_date": f"{when}+00", "event_cause": "accident" if i % 2 else "construction", "resolved_datetime": f"{end}+00"})
    enriched = impact.enrich(raw(spark, rows))
    fits, fit = [], models.ClearanceForest.fit
    monkeypatch.setattr(models.ClearanceForest, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    got = together(spark, table=lambda: models.clearance_table(enriched).collect(), errors=lambda: models.clearance_metrics(enriched).collect())
    assert len(got["table"]) == 2 and got["errors"][0].p50_mae < got["errors"][0].baseline_mae and len(fits) == 1
    models.clearance_table(impact.enrich(raw(spark, rows))).collect()
    assert len(fits) == 2  # another log has a fit of its own
    kept = len(models._FITS)
    del enriched, got
    gc.collect()
    assert len(models._FITS) < kept
