import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from commitloom.operators import hcl

DOCUMENT = """
# Buckets of a photo archive
resource "google_storage_bucket" "originals" {
  location = "EUROPE-WEST4"
  labels = {
    team = "archive"
  }
  lifecycle_rule {
    age = 30
    types = ["Delete"]
  }
  lifecycle_rule {
    age = 400
  }
}
resource "google_pubsub_topic" "uploads" {
  name    = "uploads" // one topic
  bucket  = google_storage_bucket.originals.name
}
resource "google_cloud_run_service" "resizer" {
  image      = "registry/resizer:7"
  listens_to = [google_pubsub_topic.uploads.id]
  depends_on = [google_storage_bucket.originals]
  script     = <<-SH
    echo "not a block {"
  SH
  dynamic "volume" {
    for_each = var.volumes
    content {
      path = volume.value.path
    }
  }
  count = 3
}
resource "google_dns_record_set" "names" {
  zone = "z-${google_storage_bucket.originals.id}-x"
  for_each = {
    www = "10.1.0.7"
    img = "10.1.0.8"
  }
}
"""


def test_parser():
    tree = hcl.parse(DOCUMENT)["resource"]
    assert tree["google_storage_bucket"]["originals"]["location"] == "EUROPE-WEST4"
    assert [b["age"] for b in tree["google_storage_bucket"]["originals"]["lifecycle_rule"]] == [30, 400]
    assert tree["google_cloud_run_service"]["resizer"]["script"].strip() == 'echo "not a block {"'
    assert tree["google_dns_record_set"]["names"]["for_each"] == {"www": "10.1.0.7", "img": "10.1.0.8"}
    assert hcl.parse_snippet("zone = ") == {} and hcl.parse_snippet(None) == {} and hcl.parse_snippet("a {") == {}
    assert hcl.parse_snippet('x = jsonencode({ a = "b" })\ny = [for s in var.l : s.id]')["y"] == "[for s in var.l : s.id]"
    assert hcl.parse_snippet("a = [\n  {\n b = 1\n },\n 2, # two\n]\n/* c } */ d = f(\n1,\n2)") == {"a": [{"b": 1}, 2], "d": "f(\n1,\n2)"}


def test_fragments():
    part = '@@ -31,6 +31,6 @@ resource "x" "y" {\n   rule {\n-    port     = 80\n+    port     = 8080\n   }\n'
    assert dict(hcl.flatten(hcl.parse_fragment(hcl.new_side(part))[0])) == {"rule.port": 8080}
    assert dict(hcl.flatten(hcl.parse_fragment(hcl.old_side(part))[0])) == {"rule.port": 80}
    # starts within a block, ends within another
    tree, status, skipped = hcl.parse_fragment('  size = 2\n}\n\nresource "a_b" "c" {\n  zone = "q"\n  tags = {\n    k = "v"\n')
    assert tree == {"size": 2, "resource": {"a_b": {"c": {"zone": "q", "tags": {"k": "v"}}}}} and status == "partial" and skipped == 3
    # a list that a block's end cuts
    assert hcl.parse_fragment('x = [\n  "a",\n}\ny = 1')[0] == {"y": 1}
    assert hcl.parse_fragment('a = 1\n= what\nb {\n  c = [1, {]\n  d = 2\n}')[0] == {"a": 1, "b": {"c": "[1, {]", "d": 2}}
    assert [hcl.parse_fragment(t)[1] for t in ("", None, " \n", "a = 1", "}", "]]]", "[" * 5000, "a {" * 5000)] == ["empty", "empty", "empty", "whole", "failed", "failed", "failed", "failed"]


@pytest.mark.parametrize("text", [DOCUMENT, 'x = [\n"a",\n}', "a = <<E\n", "/* a\n" * 50, '"' * 99, "x = [{\n" * 200, "x = [\n" * 300, "<<A\n<<B\n" * 60])
def test_every_cut_ends(text):
    """All prefixes and suffixes, and cuts of random lines, end and never raise; what strict parsing reads, the lenient one reads alike."""
    step = max(1, len(text) // 300)
    for i in range(0, len(text), step):
        for piece in (text[:i], text[i:]):
            tree, status, _ = hcl.parse_fragment(piece)
            assert status in ("empty", "whole", "partial", "failed")
            assert hcl.parse_snippet(piece) in ({}, tree)
    rng, lines = random.Random(5), text.split("\n")
    for _ in range(60):
        hcl.parse_fragment("\n".join(x for x in lines if rng.random() < 0.7))


@given(st.text(alphabet='a1={}[]()," \n<-E$\\/*#', max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_ends(text):
    tree = hcl.parse_fragment(text)[0]
    assert hcl.parse_snippet(text) in ({}, tree)


def test_long_texts_take_linear_time():
    start = time.perf_counter()
    for text in ("x = [\n" * 20_000, "}\n" * 50_000, "a = 1\n" * 50_000, "x = [{ a = [\n" * 150 + "]" * 150, '"' * 20_001, "/*" * 20_000, "<<T\n" * 20_000):
        hcl.parse_fragment(text)
    assert time.perf_counter() - start < 10


def test_tables(spark):
    df = spark.createDataFrame([("d", DOCUMENT), ("bad", "zone = "), ("none", None)], "id string, body string")
    attrs = hcl.attributes(df, ["id"], "body").cache()
    assert json.loads(hcl.attribute_by_path(attrs, "resource.google_storage_bucket.originals.location").first().value) == "EUROPE-WEST4" and attrs.where("id <> 'd'").count() == 0
    assert hcl.attribute_by_path(attrs, "resource.google_storage_bucket.originals.labels").count() == 1
    edges = hcl.dependencies(attrs, ["id"])
    assert {r.dst for r in hcl.depends_on(edges, "google_cloud_run_service.resizer").collect()} == {"google_pubsub_topic.uploads", "google_storage_bucket.originals"}
    assert {r.src for r in hcl.dependents_of(edges, "google_storage_bucket.originals").collect()} == {"google_pubsub_topic.uploads", "google_cloud_run_service.resizer", "google_dns_record_set.names"}
    res = {r.address: r for r in hcl.resources(attrs, ["id"]).collect()}
    assert res["google_cloud_run_service.resizer"]["count"] == "3" and res["google_dns_record_set.names"].for_each == {"www": '"10.1.0.7"', "img": '"10.1.0.8"'}
    dyn = hcl.dynamic_blocks(attrs, ["id"]).first()
    assert dyn.owner == "resource.google_cloud_run_service.resizer" and dyn.path == "resource.google_cloud_run_service.resizer.dynamic.volume"
    assert {r.resource_type for r in hcl.attribute_usage(attrs, "google_pubsub_topic").collect()} == {"google_pubsub_topic"}
    assert {(r.id, r.status) for r in hcl.parse_status(df, ["id"], "body").collect()} == {("d", "whole"), ("bad", "failed"), ("none", "empty")}
    assert json.loads({r.id: r.tree for r in hcl.to_json(df, ["id"], "body").collect()}["d"]) == hcl.parse(DOCUMENT)
    assert hcl.attributes(df.limit(0), ["id"], "body").count() == hcl.parse_status(df.limit(0), ["id"], "body").count() == 0


def test_changes(spark):
    old = spark.createDataFrame([("a", 'resource "q_zone" "main" {\n  size = 4\n  x = 1\n  of = q_disk.old.id\n}')], "id string, body string")
    new = spark.createDataFrame([("a", 'resource "q_zone" "main" {\n  size = 8\n  y = true\n  of = q_disk.new.id\n}')], "id string, body string")
    before, after = hcl.attributes(old, ["id"], "body"), hcl.attributes(new, ["id"], "body")
    got = {r.path.split(".")[-1]: (r.change, r.old_value, r.new_value) for r in hcl.attribute_changes(before, after, ["id"]).collect()}
    assert got == {"size": ("modified", "4", "8"), "x": ("removed", "1", None), "y": ("added", None, "true"), "of": ("modified", '"q_disk.old.id"', '"q_disk.new.id"')}
    assert {(r.src, r.dst, r.change) for r in hcl.dependency_changes(before, after, ["id"]).collect()} == {("q_zone.main", "q_disk.old", "removed"), ("q_zone.main", "q_disk.new", "added")}


def test_depends_on_over_long_chains(spark):
    edges = spark.createDataFrame([(f"a.r{i}", f"a.r{i + 1}") for i in range(25)] + [("a.r25", "a.r3")], "src string, dst string")
    assert {r.dst for r in hcl.depends_on(edges, "a.r0", transitive=True).collect()} == {f"a.r{i}" for i in range(1, 26)}
