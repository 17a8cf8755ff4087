from pyspark.sql import functions as F

from kerbwise import settings as S
from kerbwise.functions.text import archetype, text_signal, urgency_tier
from kerbwise.operators import cleaning, impact
from kerbwise.sources import incidents
from tests.helpers import by_id, raw


def test_null_tokens_are_exact(spark):
    rows = raw(spark, [{"zone": z} for z in ("NULL", "", "None", "null", " ", "Z")])
    got = by_id(incidents.null_tokens(rows), "zone")
    assert list(got.values()) == [None, None, None, "null", " ", "Z"]


def test_bounds_are_inclusive(spark):
    places = [("12.6", "77.3"), ("13.3", "77.9"), ("12.5999", "77.5"), ("13.0", "77.90001"), ("abc", "77.5"), ("13", None)]
    rows = raw(spark, [{"latitude": a, "longitude": b} for a, b in places])
    assert sorted(by_id(cleaning.geo_clean(rows), "lat")) == ["E1", "E2"]


def test_event_time_falls_back_to_start(spark):
    rows = raw(spark, [{"created_date": "NULL"}, {"created_date": "not a date", "start_datetime": None}])
    got = by_id(cleaning.clean(rows).withColumn("s", F.unix_seconds("t_event")), "s", "daypart", "is_weekend", "dow")
    assert got["E1"] == (1704088800, "morning", 0, 0)
    assert got["E2"] == (None, "unknown", 0, None)


def test_local_day_and_part_of_day(spark):
    # 18:30 UTC is midnight in Kolkata.
    hours = {"00:30": "night", "01:30": "morning", "06:29": "morning", "06:30": "midday", "11:29": "midday",
             "11:30": "evening", "16:29": "evening", "16:30": "late", "18:29": "late", "18:30": "night"}
    rows = raw(spark, [{"created_date": f"2024-01-06 {h}:00+00"} for h in hours])
    got = list(by_id(cleaning.clean(rows), "daypart", "dow").values())
    assert [g[0] for g in got] == list(hours.values())
    assert [g[1] for g in got] == [5] * 9 + [6]


def test_censoring_band_and_trust(spark):
    def minutes(m):
        return f"2024-01-01 {6 + int(m) // 60:02d}:{int(m) % 60:02d}:{round(m % 1 * 60):02d}+00"

    cases = [(117.9, 0), (118, 1), (182, 1), (182.1, 0)]
    rows = [{"closed_datetime": minutes(m)} for m, _ in cases]
    rows += [{"closed_datetime": minutes(120), "resolved_datetime": minutes(120)}, {"resolved_datetime": minutes(120)}]
    rows += [{"closed_datetime": "2024-01-01 06:00:00+00"}, {"closed_datetime": "2024-01-02 05:59:00+00"},
             {"closed_datetime": "2024-01-02 06:00:00+00"}, {}]
    got = list(by_id(cleaning.clean(raw(spark, rows)), "clearance_censored", "dur_trust_min").values())
    assert [g[0] for g in got] == [0, 1, 1, 0, 0, 0, 0, 0, 0, 0]
    assert [g[1] is None for g in got] == [False, True, True, False, False, False, True, False, True, True]


def test_categories(spark):
    rows = raw(spark, [{"event_type": " Planned\t", "event_cause": "Debris ", "priority": None,
                        "requires_road_closure": "true", "corridor": None},
                       {"event_cause": None, "corridor": "Ring Road ", "requires_road_closure": None}])
    got = by_id(cleaning.clean(rows), "event_type", "cause", "priority", "closure", "corridor", "is_corridor")
    assert got["E1"] == ("planned", "debris", "Low", 1, "Non-corridor", 0)
    assert got["E2"] == ("unplanned", "others", "Low", 0, "Ring Road", 1)


def test_text_rules(spark):
    texts = {"Traffic SLOW": 1, "all normal": -1, "slow but cleared": 0, "parked": 0, None: 0, "ಟ್ರಾಫಿಕ್ ಜಾಮ್": 1,
             "ಸಮಸ್ಯೆ ಇಲ್ಲ": -1, "token": 0, "it is ok now": -1}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text_signal(F.col("t"))).collect()] == list(texts.values())
    df = spark.createDataFrame([("IPL at temple",), ("asphalt laying",), ("kXride",), (None,)], "t string")
    labels = df.select(archetype(F.col("t")), archetype(F.col("t"), S.CALENDAR_RULES)).collect()
    assert [r[0] for r in labels] == ["Chinnaswamy Stadium (cricket/IPL)", "Infrastructure works", "Infrastructure works", "Other planned"]
    assert [r[1] for r in labels] == ["Chinnaswamy cricket/IPL", "Other planned", "Infrastructure works", "Other planned"]


def test_urgency(spark):
    df = spark.createDataFrame([("accident", ""), ("unknown", ""), ("accident", "VIP movement")], "c string, a string")
    assert [r[0] for r in df.select(urgency_tier(F.col("c"), F.col("a"))).collect()] == ["red", "std", "green"]


def test_clearance_fallback_and_clip(spark):
    def closed(hours, minute=0):
        return {"resolved_datetime": f"2024-01-01 {6 + hours:02d}:{minute:02d}:00+00"}

    rows = raw(spark, [
        {"event_cause": "a", "priority": "High", **closed(1)},
        {"event_cause": "a", "priority": "High", "corridor": None},
        {"event_cause": "a", "priority": "Low"},
        {"event_cause": "b"},
        {"event_cause": "c", **closed(0, 1)},
        {"event_cause": "d", **closed(16)},
    ])
    got = by_id(impact.enrich(rows), "exp_clearance_min")
    # Level 3, level 2, level 1, overall median of 1, 60, 960 minutes, and both clips.
    assert got == {"E1": 60.0, "E2": 60.0, "E3": 60.0, "E4": 60.0, "E5": 2.0, "E6": 600.0}


def test_impact_and_criticality(spark):
    rows = raw(spark, [
        {"priority": "High", "requires_road_closure": "TRUE", "description": "jam", "resolved_datetime": "2024-01-01 07:00:00+00"},
        {"corridor": None, "resolved_datetime": "2024-01-01 07:00:00+00"},
    ])
    got = by_id(impact.enrich(rows), "corridor_crit", "impact_min")
    assert abs(got["E1"][0] - 2.0) < 1e-6 and got["E2"][0] == 1.0
    assert got["E1"][1] == 540.0 and got["E2"][1] == 60.0


def test_csv_scan_keeps_line_breaks(spark, tmp_path):
    path = tmp_path / "log.csv"
    header = list(incidents.RAW_COLUMNS)[::-1] + ["extra"]
    line = {c: "" for c in header} | {"id": "7", "description": '"two\nlines, ""quoted"""', "zone": "n/a", "latitude": "12.9"}
    path.write_text(",".join(header) + "\n" + ",".join(line[c] for c in header) + "\n", encoding="utf-8")
    row = incidents.scan_csv(spark, str(path)).collect()[0]
    assert (row["id"], row["description"], row["zone"], row["latitude"]) == ("7", 'two\nlines, "quoted"', None, "12.9")
