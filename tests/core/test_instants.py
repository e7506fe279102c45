import datetime as dt

import pytest

from mnestra.operators.instants import Zones, fit_mixture, normalise_instants, readings

RULES = {"slash": "month_first", "dot": "day_first"}


def ms(*parts, micro=0):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp()) * 1000 + micro // 1000


CASES = [
    ("2025-01-06T04:38:33.718Z", None, ms(2025, 1, 6, 4, 38, 33) + 718),
    ("2025-01-06t04:38:33,7189z", None, ms(2025, 1, 6, 4, 38, 33) + 718),
    ("2024-12-23 06:56:12.775 -05:00", "Asia/Seoul", ms(2024, 12, 23, 11, 56, 12) + 775),
    ("2026-11-01T11:39:55.549+0545", None, ms(2026, 11, 1, 5, 54, 55) + 549),
    ("2024-12-19T12:17:56+01", None, ms(2024, 12, 19, 11, 17, 56)),
    ("2024-12-15T16:13:53-00:00", "Asia/Seoul", ms(2024, 12, 15, 16, 13, 53)),
    ("20241213T235147Z", None, ms(2024, 12, 13, 23, 51, 47)),
    ("2025-07-05T10:00:00", "America/New_York", ms(2025, 7, 5, 14, 0)),
    ("2025-07-05T10:00:00", None, "no_zone"),
    ("2024-12-19T04:20:22[Asia/Seoul]", "Europe/Berlin", ms(2024, 12, 18, 19, 20, 22)),
    ("2024-12-15 09:15 Asia/Kolkata", None, ms(2024, 12, 15, 3, 45)),
    ("2024-12-14 01:16:20 KST", "Asia/Seoul", ms(2024, 12, 13, 16, 16, 20)),
    ("2026-11-01 01:30:00 EST", "America/New_York", ms(2026, 11, 1, 6, 30)),
    ("2026-11-01 01:30:00 EDT", "America/New_York", ms(2026, 11, 1, 5, 30)),
    ("2026-11-01 01:30:00", "America/New_York", "twice"),
    ("2025-03-09 02:30:00", "America/New_York", "never"),
    ("2026-01-01 01:30:00 EST", "Asia/Seoul", "no_zone"),
    ("Fri, 01 Aug 2025 00:25:01 GMT", None, ms(2025, 8, 1, 0, 25, 1)),
    ("Mon, 02 Feb 2026 08:05:47 +1100", None, ms(2026, 2, 1, 21, 5, 47)),
    ("April 10, 2025 at 14:08", "UTC", ms(2025, 4, 10, 14, 8)),
    ("Apr 1, 2025 12:53 AM UTC", None, ms(2025, 4, 1, 0, 53)),
    ("Sep 30, 2025 12:05 PM BST", "Europe/London", ms(2025, 9, 30, 11, 5)),
    ("2025년 1월 11일 오전 12시 19분", "Asia/Seoul", ms(2025, 1, 10, 15, 19)),
    ("2026년 6월 28일 오후 3시 34분", "Asia/Seoul", ms(2026, 6, 28, 6, 34)),
    ("01/02/2025 04:38 PM", "UTC", ms(2025, 1, 2, 16, 38)),
    ("13/02/2025 04:38 PM", "UTC", "impossible"),
    ("03.06.2025", "Europe/Berlin", ms(2025, 6, 2, 22, 0)),
    ("2025/01/21", "Asia/Kolkata", ms(2025, 1, 20, 18, 30)),
    ("20250121", "UTC", ms(2025, 1, 21)),
    ("10 Nov 2025", "UTC", ms(2025, 11, 10)),
    (" 1734155614 ", None, 1734155614000),
    ("1734150271.3409", None, 1734150271340),
    ("1734248877294", None, 1734248877294),
    ("1734302627450993", None, 1734302627450),
    ("1770214976971355412", None, 1770214976971),
    ("2024-02-30T04:57:20Z", None, "impossible"),
    ("2026-13-30T23:02:18+00:00", None, "impossible"),
    ("0000-00-00", "UTC", "impossible"),
    ("2025-01-01T25:00:00Z", None, "impossible"),
    ("n/a", "UTC", "filler"),
    ("yesterday", "UTC", "filler"),
    ("", "UTC", "filler"),
    ("12345", "UTC", "filler"),
    ("지난주", "UTC", "filler"),
]


@pytest.mark.parametrize("value,zone,want", CASES)
def test_readings(value, zone, want):
    found = readings(value, zone, Zones(), RULES)
    favoured = {f"{notation}_{order}" for notation, order in RULES.items()}
    ((_, state, got),) = [r for r in found if len(found) == 1 or r[0] in favoured]
    assert (got if state == "instant" else state) == want


def test_mixture_learns_the_order_of_a_source():
    weights = fit_mixture([(("slash_day_first", 3),), (("slash_day_first", 3), ("slash_month_first", 3))], [50, 50])
    assert weights["slash_day_first"] > 0.98


def test_a_declared_order_is_a_prior_that_the_posterior_follows(spark):
    rows = [(i, "f", "uk", "UTC", f"{13 + i % 15}/05/2025") for i in range(60)] + [(100, "f", "uk", "UTC", "04/05/2025"), (101, "f", "uk", "UTC", "04.05.2025")]
    df = spark.createDataFrame(rows, "id long, field_name string, source string, tz string, value string")
    got = {r["id"]: r for r in normalise_instants(df, RULES).collect()}
    assert all(got[i]["state"] == "impossible" and 0.95 < got[i]["posterior"] < 1 for i in range(60))
    assert (got[100]["state"], got[100]["utc_ms"]) == ("instant", ms(2025, 4, 5)) and 0.95 < got[100]["posterior"] < 1
    assert (got[101]["state"], got[101]["utc_ms"]) == ("instant", ms(2025, 5, 4))


def test_the_time_of_receipt_decides_between_readings(spark):
    rows = [(i, "f", "a", "UTC", f"0{1 + i % 9}/0{1 + (i + 1) % 9}/2025", ms(2025, 1 + i % 9, 1 + (i + 1) % 9) + 3_600_000) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, field_name string, source string, tz string, value string, seen_ms long")
    got = {r["id"]: r for r in normalise_instants(df).collect()}
    assert all(got[r[0]]["state"] == "instant" and got[r[0]]["utc_ms"] == r[5] - 3_600_000 for r in rows)
    assert {r["state"] for r in normalise_instants(df.drop("seen_ms")).collect()} == {"unresolved"}


def test_sources_decide_between_readings(spark):
    rows = [(i, "f", "uk", "UTC", f"{13 + i % 15}/05/2025") for i in range(60)] + [(100, "f", "uk", "UTC", "04/05/2025")]
    rows += [(200 + i, "f", "us", "UTC", f"05/{13 + i % 15}/2025") for i in range(60)] + [(300, "f", "us", "UTC", "04/05/2025")]
    rows += [(400, "f", None, "UTC", "04/05/2025"), (401, "f", None, "UTC", "05/05/2025"), (402, "f", "uk", "UTC", None)]
    df = spark.createDataFrame(rows, "id long, field_name string, source string, tz string, value string").selectExpr("*", "1 as readings")
    got = {r["id"]: (r["state"], r["utc_ms"]) for r in normalise_instants(df).collect()}
    assert got[100] == ("instant", ms(2025, 5, 4)) and got[300] == ("instant", ms(2025, 4, 5))
    assert got[400] == ("unresolved", None) and got[401] == ("instant", ms(2025, 5, 5)) and 402 not in got


def test_empty(spark):
    assert normalise_instants(spark.createDataFrame([], "id long, field_name string, source string, tz string, value string"), RULES).collect() == []


def test_undeclared_dates_are_left_to_the_mixture_of_the_agent(spark, tmp_path):
    from mnestra.plans.problems import p4_undeclared

    rows = [(n, a, "UTC", d, None, None, dt.datetime(2026, 4, 20)) for n, (a, d) in enumerate([("us", "03/25/2026")] * 60 + [("eu", "25/03/2026")] * 60 + [("us", "04/05/2026"), ("eu", "04/05/2026")])]
    spark.createDataFrame(rows, "fact_id long, agent string, tz string, occurred_start string, event_date string, mentioned_at string, received_at timestamp").write.parquet(f"{tmp_path}/inbound_facts.parquet")
    got = {r["fact_id"]: r for r in p4_undeclared(spark, str(tmp_path)).collect()}
    assert got[120]["state"] == got[121]["state"] == "instant" and got[121]["utc_ms"] - got[120]["utc_ms"] == 29 * 86_400_000
    assert 0.95 <= got[120]["posterior"] < 1
