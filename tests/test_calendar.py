"""The stored calendar gives what the plain windows give, without an exchange of prices, whatever batches it came in."""

import re
import uuid
from datetime import date, timedelta

import pytest

from quarry.operators import returns
from quarry.operators.calendar import PriceCalendar
from quarry.operators.storage import Manifest

DAY = date(2024, 1, 1)
PRICES = "ticker string, date date, close double"


@pytest.fixture()
def calendar(spark, tmp_path):
    made = PriceCalendar(spark, f"cal{uuid.uuid4().hex[:8]}", f"file://{tmp_path}/calendar", buckets=6)
    yield made
    for t in spark.catalog.listTables():
        if t.name.startswith(made.name):
            spark.sql(f"DROP TABLE {t.name}")


def prices(spark, days, tickers=("a", "b", "c"), factor=37):
    return spark.createDataFrame([(t, DAY + timedelta(days=i), 1.0 + (i * factor + ord(t)) % 101) for t in tickers for i in days], PRICES)


def events(spark):
    rows = [(t, DAY + timedelta(days=i), i) for t in ("a", "b", "zz", None) for i in range(-9, 320, 4)] + [("a", None, 1), ("a", DAY, 2), ("a", DAY, 2)]
    return spark.createDataFrame(rows, "ticker string, date date, n int")


def rows(df):
    return sorted(map(str, df.collect()))


def test_batches_give_what_one_calendar_gives(spark, calendar):
    days = [i for i in range(300) if i % 7 not in (5, 6) and not 100 <= i < 130]  # weekends and a gap
    for part in ([i for i in days if i < 90], [i for i in days if 90 <= i < 200], [i for i in days if i >= 200]):
        calendar.append(prices(spark, part))
    want = rows(returns.forward(events(spark), prices(spark, days)))
    assert want and rows(calendar.forward(events(spark))) == want
    assert calendar.compact(least=4) is False and calendar.compact(least=3) is True and len(calendar.batches()) == 1
    assert rows(calendar.forward(events(spark))) == want
    assert len(calendar.vacuum()) == 1 and rows(calendar.read()) == rows(prices(spark, days))


def test_prices_are_in_no_exchange(spark, calendar):
    calendar.append(prices(spark, range(100)))
    calendar.append(prices(spark, range(100, 160)))
    plan = calendar.forward(events(spark))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(i for i, s in enumerate(lines) if calendar.name in s)
    depth = re.search(r"[A-Z]", lines[scan]).start()
    above = []
    for s in reversed(lines[:scan]):  # the operators over the scan, up to the join with the days
        if re.search(r"[A-Z*]", s).start() < depth:
            depth = re.search(r"[A-Z*]", s).start()
            above.append(s)
            if "SortMergeJoin" in s:
                break
    assert "SortMergeJoin" in above[-1] and any("Window" in s for s in above)
    assert not any("Exchange" in s for s in above) and "Bucketed: true" in lines[scan]


def test_later_batches_count_and_odd_rows_do_not(spark, calendar):
    calendar.append(spark.createDataFrame([("a", DAY, 1.0), ("a", DAY, 2.0), (None, DAY, 3.0), ("a", None, 3.0), ("b", DAY, None)], PRICES))
    calendar.append(spark.createDataFrame([("a", DAY, 1.5)], PRICES))
    assert [tuple(r) for r in calendar.read().collect()] == [("a", DAY, 1.5)]


def test_an_empty_calendar_has_no_returns(spark, calendar):
    assert calendar.read().count() == 0 and calendar.forward(events(spark)).count() == 0
    calendar.append(prices(spark, []))
    assert calendar.read().count() == 0 and calendar.forward(events(spark)).count() == 0


def test_a_write_without_commit_changes_nothing(spark, calendar, monkeypatch):
    calendar.append(prices(spark, range(5)))
    before = rows(calendar.read())

    def dies(self, edit):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(Manifest, "change", dies)
        with pytest.raises(OSError):
            calendar.append(prices(spark, range(5, 9)))
    assert rows(calendar.read()) == before
    calendar.append(prices(spark, range(5, 9)))
    assert rows(calendar.read()) == rows(prices(spark, range(9)))


def test_a_batch_that_arrives_during_compaction_stays(spark, calendar, tmp_path):
    calendar.append(prices(spark, range(3)))
    other = PriceCalendar(spark, calendar.name, f"file://{tmp_path}/calendar")
    assert other.buckets == 6
    write = calendar._write

    def slow(df, table):
        batch = write(df, table)
        other.append(prices(spark, range(3, 5)))
        return batch

    calendar._write = slow
    assert calendar.compact(least=1) is False
    assert rows(calendar.read()) == rows(prices(spark, range(5)))
