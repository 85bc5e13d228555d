"""A bucketed store of bodies and the lines between two states."""

import random
import re
import uuid
from collections import Counter

from pagetide.sources.bodies import add_bodies, bodies_of, lines_between


def test_store_holds_each_body_once(spark, tmp_path):
    name = f"store_{uuid.uuid4().hex[:8]}"
    rows = [("a",), ("b",), ("a",), (None,), ("",)]
    for part in (rows, rows, [("c",)]):
        add_bodies(spark.createDataFrame(part, "body string"), name, f"{tmp_path}/s", 8)
    assert sorted(r["body"] for r in spark.table(name).collect()) == ["", "a", "b", "c"]
    assert bodies_of(spark.createDataFrame([("none",), (None,)], "sha256 string"), spark, name).collect() == []


def test_lines_between_states(spark, tmp_path):
    import hashlib

    rng, name = random.Random(8), f"store_{uuid.uuid4().hex[:8]}"
    texts = ["\n".join(rng.choice(["x", "y", "", "z"]) for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    sha = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    add_bodies(spark.createDataFrame([(t,) for t in texts], "body string"), name, f"{tmp_path}/s", 8)
    # a third of all targets went through one change
    pairs = [(k, rng.choice([None, *texts]) if k % 3 else texts[0], rng.choice([None, *texts]) if k % 3 else texts[1]) for k in range(300)]
    states = spark.createDataFrame([(k, sha(a), sha(b)) for k, a, b in pairs] + [(999, sha("gone"), sha(texts[0]))], "k int, before_sha256 string, after_sha256 string")
    expected = set()
    for k, a, b in pairs:
        if a is not None and b is not None:
            o, n = Counter(a.split("\n")), Counter(b.split("\n"))
            expected |= {(k, x, max(0, o[x] - n[x]), max(0, n[x] - o[x])) for x in o | n if o[x] != n[x]}
    lines = lines_between(states, ["k"], spark, name)
    assert {(r["k"], r["line"], r["removed"], r["added"]) for r in lines.collect()} == expected
    assert lines_between(states.limit(0), ["k"], spark, name).collect() == []


def test_the_store_is_not_shuffled(spark, tmp_path):
    name = f"store_{uuid.uuid4().hex[:8]}"
    add_bodies(spark.createDataFrame([(str(k),) for k in range(100)], "body string"), name, f"{tmp_path}/s", 8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bodies_of(spark.table(name).select("sha256").limit(50), spark, name)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # what stands above the store's scan up to the join: a line of the tree a level
    store = plan[plan.index("SortMergeJoin") :]
    first = re.search(r"Scan parquet [^\n]*body", store)
    assert first and "Exchange" not in store[: first.start()] and "Bucketed: true" in plan
