"""Column functions on hand-written rows; expected values worked out by hand."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tests.frames import values
from wrenchlight.functions import labels, numbers, text, times


def test_normalize_tags(spark):
    rows = [None, "", " , ", "Install", "A, b,,", "Residential,INSTALL,install", " Café ,\tX ", "a b , c"]
    assert values(spark, text.normalize_tags("x"), rows) == [
        "", "", "", "install", "a,b", "residential,install,install", "café,x", "a b,c",
    ]
    assert values(spark, text.normalize_tags_distinct("x"), rows) == [
        "", "", "", "install", "a|b", "residential|install", "café|x", "a b|c",
    ]


@pytest.mark.parametrize("needle", ["install", "new build", "new-build", "call back", "dfo", "a.b", ""])
def test_tag_has_is_whole_word_or_phrase(spark, needle):
    rows = [
        None, "", "install", "reinstall", "re install", "pre,install,x", "INSTALL", "installs", "new build",
        "brand new buildings", "new-build", "new-builds", "call back", "call backs", "dfo", "a.b", "axb",
        "dfo x", "x dfo", "x\tdfo",
    ]

    def expected(tags):
        if not tags or not needle:
            return False
        tags = tags.strip().lower()
        if " " in needle:
            return needle in tags
        return any(part == needle for part in re.split(r"[\s,]", tags))

    assert values(spark, text.tag_has("x", needle), rows) == [expected(r) for r in rows]


def test_callback_and_dfo(spark):
    rows = ["callback", "x,Call Back", "call-back", "recall", "recalled", "warranty", "warrantee", "dfo", None]
    assert values(spark, text.is_callback("x"), rows) == [True, True, True, True, False, True, True, False, False]
    assert values(spark, text.is_dfo("x"), rows) == [False] * 7 + [True, False]


def test_contains_any(spark):
    rows = [None, "", "a WIZARD came", "membership", "remembered", "service plans", "service, plan"]
    assert values(spark, text.has_club_word("x"), rows) == [False, False, True, True, True, True, False]
    assert values(spark, text.contains_any("x", ["", "  "]), ["  ", "a"]) == [False, False]


@pytest.mark.parametrize(
    ("tags", "category"),
    [
        (None, "Other / Unclassified"),
        ("Residential", "Other / Unclassified"),
        ("Residential,Install", "Residential Install"),
        ("Residential,reinstall", "Other / Unclassified"),
        ("Residential,change-out,maintenance", "Residential Install"),
        ("Residential, Maintenance, Service", "Residential Maintenance"),
        ("Demand Service, Residential", "Residential Service"),
        ("non-residential, demand", "Residential Service"),
        ("Commercial,Change Out", "Commercial Install"),
        ("commercial maintenance", "Commercial Maintenance"),
        ("Commercial,Residential,Service", "Residential Service"),
        ("commercial,service", "Commercial Service"),
        ("install", "Other / Unclassified"),
        ("New Construction,Residential,Install", "New Construction"),
        ("new-build", "New Construction"),
        ("newconstruction site", "New Construction"),
        ("some new buildings", "New Construction"),
    ],
)
def test_job_category(spark, tags, category):
    assert values(spark, labels.job_category("x"), [tags]) == [category]
    assert values(spark, labels.may_have_category("x"), [tags])[0] or category == labels.UNCLASSIFIED
    is_install = values(spark, labels.is_install_category(labels.job_category("x")), [tags])[0]
    assert is_install == ("Install" in category)
    assert values(spark, labels.may_be_install("x"), [tags])[0] or not is_install


def test_option_outcomes(spark):
    rows = [
        ("approved", "declined"), (None, None), ("Cancelled ", ""), (" Pro Approved", None), ("x", "sold"),
        ("declined", "in progress"), ("", "void"), ("waiting", "submitted"),
    ]
    ddl = "a string, s string"
    outcome = labels.outcome_name(labels.outcome_weight("a", "s"))
    assert values(spark, outcome, rows, ddl) == ["won", "pending", "lost", "won", "won", "won", "lost", "pending"]
    assert values(spark, labels.option_bucket("a", "s"), rows, ddl) == [
        "approved", "unknown", "cancelled", "pro approved", "x", "declined", "void", "waiting",
    ]


def test_status_levels_at_their_limits(spark):
    rows = [0.0, 4.99, 5.0, 5.01, 9.99, 10.0, 10.01]
    assert values(spark, labels.below_levels("x", 5, 10), rows, "x double") == [
        "success", "success", "warning", "warning", "warning", "danger", "danger",
    ]
    assert values(spark, labels.up_to_levels("x", 5, 10), rows, "x double") == [
        "success", "success", "success", "warning", "warning", "warning", "danger",
    ]
    assert values(spark, labels.at_least("x", 450), ["449.99", "450", "bad", None]) == [
        "danger", "success", "danger", "danger",
    ]


def test_currency(spark):
    rows = ["0", "2.5", "3.5", "1234567.4", "-1234", "nan", "inf", "-inf", "bad", None]
    assert values(spark, numbers.currency("x"), rows) == [
        "$0", "$2", "$4", "$1,234,567", "$-1,234", "$0", "$0", "$0", "$0", "$0",
    ]


def test_cents_and_dollars(spark):
    rows = ["1999", " 20 ", "12.0", "bad", None, "NaN"]
    assert values(spark, numbers.to_cents("x"), rows) == [1999, 20, 12, None, None, None]
    assert values(spark, numbers.dollars("x"), rows[:5]) == [19.99, 0.2, 0.12, 0.0, 0.0]


def test_ratios(spark):
    rows = [(1, 3), (1, 0), (0, 5), (5, 80), (None, 4)]
    ddl = "n bigint, d bigint"
    assert values(spark, numbers.percent("n", "d", 1), rows, ddl) == [33.3, 0.0, 0.0, 6.2, None]
    assert values(spark, numbers.ratio("n", "d", 3), rows, ddl)[:3] == [0.333, 0.0, 0.0]
    assert values(spark, numbers.fixed_point(F.col("x"), 1, "%"), [6.25, 0.0], "x double") == ["6.2%", "0.0%"]
    assert values(spark, numbers.fixed_point(F.col("x"), 1, " hrs"), [12.0], "x double") == ["12.0 hrs"]
    assert values(spark, numbers.clamp_percent("x"), [-1.0, 50.0, 101.0], "x double") == [0.0, 50.0, 100.0]


def test_times(spark):
    rows = ["2026-01-01", "2026-01-01T05:59:59Z", "2026-01-01T06:00:00.5Z", "2026-01-01T00:00:00-05:00", "bad", None]
    shown = F.date_format(times.parse_time("x"), "yyyy-MM-dd HH:mm:ss.S")
    assert values(spark, shown, rows) == [
        "2026-01-01 00:00:00.0", "2026-01-01 05:59:59.0", "2026-01-01 06:00:00.5", "2026-01-01 05:00:00.0", None, None,
    ]
    start = F.date_format(times.year_start(times.parse_time("x")), "yyyy-MM-dd HH:mm")
    assert values(spark, start, rows[:3]) == ["2025-01-01 06:00", "2025-01-01 06:00", "2026-01-01 06:00"]
    assert values(spark, times.display(times.parse_time("x")), ["2026-07-04T17:05:00Z", "2026-01-04T01:05:00Z", None]) == [
        "Jul 04, 2026 12:05 PM", "Jan 03, 2026 07:05 PM", "",
    ]
    assert values(spark, times.display_with_zone(times.parse_time("x")), ["2026-07-04T17:05:00Z", "2026-01-04T01:05:00Z", None]) == [
        "Jul 04, 2026 12:05 PM CDT", "Jan 03, 2026 07:05 PM CST", "",
    ]
    other = times.zone_label(times.parse_time("x"), "Asia/Kolkata")
    assert values(spark, other, ["2026-01-01T00:00:00Z"]) == ["UTC+05:30"]
    # Buckets are cut in UTC.
    assert values(spark, times.month_of(times.parse_time("x")), ["2026-02-01T00:30:00Z"]) == ["2026-02"]


def test_worked_time(spark):
    rows = [("2026-01-01T00:00:00Z", "2026-01-01T01:30:00Z"), ("2026-01-01", "2026-01-02"), (None, "2026-01-02")]
    micros = times.worked_micros(times.parse_time("s"), times.parse_time("e"))
    assert values(spark, micros, rows, "s string, e string") == [5_400_000_000, 86_400_000_000, 0]


def test_names(spark):
    rows = [(None, None), (" Ann ", " Lee "), ("", "Lee"), ("Ann", None), ("  ", "  ")]
    ddl = "f string, l string"
    assert values(spark, text.customer_name("f", "l"), rows, ddl) == ["Unknown", "Ann Lee", "Lee", "Ann", ""]
    assert values(spark, text.employee_name("f", "l"), rows, ddl) == ["Unknown", "Ann Lee", "Lee", "Ann", "Unknown"]
    ids = ["pro_" + "0a" * 16, "pro_" + "0a" * 15, "pro_" + "0A" * 16, "x pro_" + "0a" * 16, None]
    assert values(spark, text.looks_like_raw_id("x"), ids) == [True, False, False, False, False]


def test_given_minutes_come_first(spark):
    rows = [("2026-01-01 10:00:00", "2026-01-01 11:30:00", m) for m in (None, 0.0, -5.0, 20.0, 0.5)] + [(None, "2026-01-01 11:30:00", 7.0), (None, None, None)]
    frame = spark.createDataFrame(rows, "s string, e string, m double")
    micros = times.worked_micros(times.parse_time("s"), times.parse_time("e"), "m")
    assert [r[0] / 60_000_000 for r in frame.select(micros).collect()] == [90, 90, 90, 20, 0.5, 7, 0]
