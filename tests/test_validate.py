"""Concepts and checks."""

import pytest
from pyspark.sql import functions as F

from quorumlake.functions.concepts import RULES, concepts
from quorumlake.operators import validate


CASES = [
    ("A man denies chest pain. He has a migraine.", ["migraine"]),
    ("no history of asthma and reports chest pain", ["chest pain"]),
    ("Gram–negative, oxidase negative; maltose not fermented", ["maltose", "gram negative", "oxidase"]),
    # Six words before count, the denial among them; clause marks and clause words end its reach.
    ("no one two three four five six asthma", ["asthma"]),
    ("no one two three four five asthma", []),
    ("negative for one two three four asthma", []),
    ("negative for one two three four five asthma", ["asthma"]),
    ("without fever but asthma", ["asthma"]),
    ("not now (asthma)", []),
    ("asthma; no asthma", ["asthma"]),
    ("no asthma. Later asthma", ["asthma"]),
    ("nothing here", []),
    ("", []),
    (None, []),
]


def test_concepts(spark):
    assert len(RULES) == 85
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k int, t string")
    got = {r.k: r.c for r in df.select("k", concepts(F.col("t")).alias("c")).collect()}
    assert got == {k: c for k, (_, c) in enumerate(CASES)}
    many = spark.createDataFrame([("diabetes mellitus and diabetes insipidus",), ("asthma hepatitis pneumonia meningitis migraine lupus neutropenia eosinophilia leukocytosis syncope",)], "t string")
    one, eight = (r.c for r in many.select(concepts(F.col("t"), 20).alias("c")).collect())
    assert one == ["diabetes mellitus"] and len(eight) == 8


def test_concepts_search_once(spark, monkeypatch):
    """A text is put in lower case once, not once for each rule and again for its query; rules left out for want of a literal match nothing."""
    import random
    import re

    from quorumlake import queries as Q
    from quorumlake.functions import concepts as K

    plan = Q.QUERIES["concept_queries"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    assert K.needles(r"st[ -](?:segment[ -])?elevation") == ["elevation"] and K.needles(r"hiv|blood in (?:the )?urine") == ["hiv", "blood in "]
    assert K.needles(r"(?i)HIV") == K.needles(r"(?:a|b)") == K.needles(r"a*\d+") == [""] and K.needles(r"ab+c{0,2}x\(y") == ["ab"]
    r = random.Random(4)
    parts = [w for rule in RULES for w in re.sub(r"[^a-z -]+", " ", rule[1]).split()] + ["no", "denies", "5 kg", "and has", ";", "negative for"]
    df = spark.createDataFrame([(k, " ".join(r.choices(parts, k=r.randint(1, 40)))) for k in range(400)], "k int, t string")
    run = lambda: {x.k: x.c for x in df.select("k", K.concepts(F.col("t"), 8).alias("c")).collect()}
    some = run()
    monkeypatch.setattr(K, "needles", lambda pattern: [""])
    assert some == run() and sum(map(len, some.values())) > 400


def test_checks(spark):
    df = spark.createDataFrame([(9, 0, 1, 0.9, 0.0, 0.1, 0.29590327428938457, 1.0), (9, 0, 1, 0.8, 0.0, 0.2, 0.3, 1.0), (5, 5, 5, 0.5, 0.5, 0.0, 0.6, 0.0)], "n_s int, n_c int, n_i int, p_s double, p_c double, p_i double, u_3 double, directional_score double")
    assert [r[0] for r in df.select(validate.frequency_ok()).collect()] == [True, False, False]
    with pytest.raises(Exception, match="bad frequency"):
        validate.require(df, validate.frequency_ok(), "bad frequency").collect()
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in ("abc", "bcd"))
    assert {(r.k, r.difference) for r in validate.key_differences(a, b, ["k"]).collect()} == {("a", "missing"), ("d", "unexpected")}
    assert [r.k for r in validate.orphans(b, a, "k").collect()] == ["d"]
    raw = spark.createDataFrame([('  "heart  failure AND x" \n',), ("a\nb",), ("- a",), ("Query: a",), ('{"q": 1}',), ("```x```",), ("",), (None,), ("plain",)], "q string")
    assert [r[0] for r in raw.select(validate.one_line_query(F.col("q"))).collect()] == ["heart failure AND x", None, None, None, None, None, None, None, "plain"]


def test_close_and_paths(tmp_path):
    validate.close({"a": [1, 0.5, None]}, {"a": [1, 0.5 + 1e-14, None]})
    for actual, expected in (({"a": 1}, {"b": 1}), ([1], [1, 2]), (0.5, 0.6), (True, 1), ("x", "y")):
        with pytest.raises(ValueError):
            validate.close(actual, expected)
    assert validate.inside(str(tmp_path), "a/b").endswith("/a/b")
    for bad in ("", "/a", "../a", "a/../../b"):
        with pytest.raises(ValueError):
            validate.inside(str(tmp_path), bad)
