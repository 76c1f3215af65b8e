import random
from datetime import timedelta

from history import CLOCK, NOW, file, library, listen, listens, rows

from earshot.operators import distincts, topstats, yearly
from pyspark.sql import functions as F


def history(spark, seed, n=400):
    rng = random.Random(seed)
    names = ["Unknown", None, "A; B", "B", "A", "C ft. D", ""]
    data = [
        listen(i, NOW - timedelta(hours=rng.randrange(24 * 500)), track=rng.choice([f"t{rng.randrange(90)}", "Unknown", None]), artist=rng.choice(names), album=rng.choice(["Unknown", "x", "y", None]), artist_id=rng.choice(["r", None]))
        for i in range(n)
    ]
    return listens(spark, *data)


def test_bitmaps_count_exactly_and_add_up(spark):
    files = library(spark, file("1", artist="A & E", participants='{"artist": [{"name": "A"}, {"name": "E"}]}'))
    one, other = history(spark, 1), history(spark, 2).withColumn("id", F.col("id") + 1000)
    first = distincts.heard_names(one, files)
    numbered = distincts.number_names(first)
    bitmaps = distincts.day_bitmaps(first, numbered)
    # A later commit numbers only what is new and adds bitmaps of its own.
    second = distincts.heard_names(other, files)
    more = distincts.number_names(second, numbered)
    assert sorted(rows(numbered)) == sorted(r for r in rows(more) if r[2] <= numbered.count())
    assert sorted(r.number for r in more.collect()) == list(range(1, more.count() + 1))
    bitmaps = bitmaps.unionByName(distincts.day_bitmaps(second, more))
    both = one.unionByName(other)
    got = distincts.unique_counts(bitmaps, both.agg(F.count(F.lit(1))))
    assert sorted(rows(got)) == sorted(rows(topstats.unique_counts(both, files)))
    for year in (2023, 2024, 2020):
        summary = distincts.year_summary(both, bitmaps, CLOCK, year)
        assert rows(summary) == rows(yearly.year_summary(both, CLOCK, year, files).select(*summary.columns))
    assert "Expand" not in summary._jdf.queryExecution().executedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()


def test_names_of_days_come_from_one_reading(spark):
    one = history(spark, 3)
    files = library(spark, file("1", artist="A & E", participants='{"artist": [{"name": "A"}, {"name": "E"}]}'))
    heard = distincts.heard_names(one, files)
    # The days' names were written; credits are split apart from the days.
    plan = heard._jdf.queryExecution().optimizedPlan().toString()
    assert "track_name" not in plan and "to_date" not in plan and heard.count() == heard.distinct().count()
    assert {r.kind for r in heard.collect()} == set(distincts.KINDS)
