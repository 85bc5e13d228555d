"""Places in an order over all rows; names of counties of any length in titles."""

import random

from pyspark.sql import functions as F

from pagetide.operators import discovery
from pagetide.operators.order import numbered


def test_places_are_those_of_one_sorted_list(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), k) for k in range(5000)]
    rng.shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "c string, k int").repartition(13), F.desc("c"), "k", name="n").collect()
    expected = {r: n for n, r in enumerate(sorted(rows, key=lambda r: (-ord(r[0]), r[1])), 1)}
    assert {(r["c"], r["k"]): r["n"] for r in got} == expected and len(got) == 5000
    assert numbered(spark.createDataFrame([], "c string, k int"), "c").collect() == []
    assert [r["position"] for r in numbered(spark.createDataFrame([("x", None)], "c string, k int"), "k").collect()] == [1]


def test_names_of_any_length_in_titles(spark):
    names = spark.createDataFrame([(n,) for n in ("Smith", "Deaf Smith", "Saint John The Baptist Of The Lake", "The Lake", "O'Brien", "Á Coruña", "", None)], "county string")
    cases = [
        ("Smith", "Deaf  Smith County", None),  # two blanks: not that name, and "Smith" is the own one
        ("Smith", "Deaf Smith\tCounty", ["deaf smith"]),
        ("Deaf Smith", "Deaf Smith County", None),
        ("Smith", "Saint John the Baptist of the Lake County Clerk", ["saint john the baptist of the lake", "the lake"]),
        ("The Lake", "Saint John The Baptist Of The Lake County | Smith County", ["saint john the baptist of the lake"]),
        ("Smith", "Xthe Lake County", None),
        ("Smith", "O'Brien county, (O'Brien County)", ["o'brien"]),
        ("Smith", "in Á Coruña County", ["á coruña"]),
        ("Smith", "The Lake\nCounty", None),
        ("Smith", "The Lake Countywide", None),
        ("Smith", None, None),
        ("Smith", "", None),
        ("Smith", "The Lake County " * 3000, ["the lake"]),
    ]
    df = spark.createDataFrame([(k, c, t) for k, (c, t, _) in enumerate(cases)], "id int, county string, title string")
    got = {r["id"]: sorted(r["others"]) for r in discovery.other_counties(df, names, "id").collect()}
    assert got == {k: e for k, (_, _, e) in enumerate(cases) if e}
    assert discovery.other_counties(df, names.limit(0), "id").collect() == []
