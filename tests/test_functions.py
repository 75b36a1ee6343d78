import time

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commitloom.functions import paths, text
from commitloom.functions.instants import to_instant
from commitloom.functions.tokens import PY_TOKEN, token_count


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, want", [
    ("2024-08-14T08:14:37-07:00", datetime(2024, 8, 14, 15, 14, 37)),
    ("2022-12-26T11:16:01Z", datetime(2022, 12, 26, 11, 16, 1)),
    ("2023-05-12 18:09:48 +0200", datetime(2023, 5, 12, 16, 9, 48)),
    ("Tue Feb 8 15:02:38 2022 +0900", datetime(2022, 2, 8, 6, 2, 38)),
    ("Sat Dec 14 06:14:25 2024 +0900", datetime(2024, 12, 13, 21, 14, 25)),
    ("Fri, 15 Mar 2024 17:17:03 +0100", datetime(2024, 3, 15, 16, 17, 3)),
    ("1710519423 +0100", datetime(2024, 3, 15, 16, 17, 3)),
    ("2023-02-30T10:00:00Z", None), ("unknown", None), ("N/A", None), ("", None), (None, None), ("2024-03-15", None),
])
def test_instants(spark, raw, want):
    assert one(spark, to_instant, raw) == want


def test_clean_message(spark):
    c = lambda v: one(spark, text.clean_message, v)
    assert c("Fix  the #12 thing https://x.y/z now\nbody") == "fix the thing now"
    assert c(" Corrige Café  x ") == "corrige café x"
    assert c("") is None and c(None) is None and c("#1") is None
    long = "word " * 40
    assert len(c(long)) <= 150 and not c(long).endswith("wor")
    assert len(c("x" * 200)) == 150


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=220), min_size=1, max_size=20))
def test_clean_message_is_idempotent_and_bounded(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for r in df.select(text.clean_message(F.col("v")).alias("a")).select("a", text.clean_message(F.col("a")).alias("b")).collect():
        assert r.a is None or len(r.a) <= 150
        assert r.a is None or "#" in r.a or "gh-" in r.a or r.a == r.b


def test_merges(spark):
    m = "Merge pull request #123 from feature/auth-fix\n\nFix OAuth token refresh"
    assert one(spark, text.merge_content, m) == "auth fix Fix OAuth token refresh"
    assert one(spark, text.merge_content, "Merge branch 'main' into x") == "main"
    assert one(spark, text.merge_content, "Add x") is None
    assert one(spark, text.clean_message_semantic, m) == "auth fix fix oauth token refresh"
    assert one(spark, text.is_merge, "🔀 Merge pull request from a") and not one(spark, text.is_merge, None)


def test_classifiers(spark):
    for m in ("tunnel: fixes the MTU of both ends", "Bugs of the parser, part two", "the agent crashes when its queue is full", "resolving #12", "an incorrect zone", "Erroring pods"):
        assert one(spark, text.is_bugfix, m)
    for m in ("a second subnet for staging", "prefix of all names", "debug output", "", None):
        assert not one(spark, text.is_bugfix, m)
    assert one(spark, text.has_keyword, "prefix everything")  # a substring counts
    assert not one(spark, lambda c: text.has_keyword(c, ()), "fix") and not one(spark, text.has_keyword, None)
    assert one(spark, text.has_emoji, "🐛 x") and not one(spark, text.has_emoji, "plain")
    assert one(spark, text.language, "a função não é para o plano") == "pt" and one(spark, text.language, "the plan of the team") == "en"


def test_words_and_terms(spark):
    assert one(spark, text.words, "  a b c ") == ["a", "b", "c"]
    assert one(spark, text.words, "") == [] and one(spark, text.words, None) == []
    assert one(spark, lambda c: text.content_words(c, ("the",)), "The 12 café x a-b ok") == ["café", "ok"]
    assert one(spark, lambda c: text.terms(c, (), True), "Fixed policies and subnets, signed-off-by: A <a@b.c>") == ["fix", "policy", "and", "subnet"]
    assert one(spark, text.terms, None) == []
    assert one(spark, text.keyword_text, "ask a@b.c or @x y@ @@z q@@ at q@w@e now") == "ask or x y at now"
    start = time.perf_counter()
    assert one(spark, text.keyword_text, "x" * 200_000 + " a@" + "b" * 200_000 + " end") == "x" * 200_000 + " end"
    assert time.perf_counter() - start < 10
    assert one(spark, lambda c: text.highlight(c, F.lit("pin")), "Pins the pinned") == "**Pins** the **pinned**"
    assert one(spark, lambda c: text.truncate(c, 3), "abcd") == "abc..."


def test_paths(spark):
    want = {"examples/main.tf": False, "a/testdata/main.tf": True, "main.tf": True, "a/test.tf": False, "x.go": False, "A\\\\Docs//x.tf": False, "": False, None: False}
    for p, ok in want.items():
        assert one(spark, paths.is_infra_file, p) is ok, p
    assert one(spark, paths.normalise, "/A\\B//c.tf/") == "a/b/c.tf"
    assert [one(spark, paths.extension, p) for p in ("a/b.TF", ".env", "x.tar.gz", "Makefile")] == [".tf", "", ".gz", ""]
    a = "array<string>"
    assert one(spark, paths.only_vendor, ["vendor/a", " vendor/b"], a) and not one(spark, paths.only_vendor, [], a) and not one(spark, paths.only_vendor, ["a"], a)
    assert not one(spark, paths.any_relevant, [None], a) and not one(spark, paths.any_relevant, ["docs/x"], a) and one(spark, paths.any_relevant, ["docs/x", "main.tf"], a)


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=60), min_size=1, max_size=20))
def test_token_count_equals_pythons(spark, texts):
    import re

    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r.n for r in df.select(token_count(F.col("v")).alias("n")).collect()] == [len(re.findall(PY_TOKEN, t)) for t in texts]
