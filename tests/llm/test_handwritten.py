import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from commitloom.llm import handwritten as H

JS = "@@ -1 +1 @@\n+" + "var a=b.c;for(var k=0;k<l.length;k++)m+=l[k];" * 12
CODE = '@@ -1,3 +1,3 @@\n resource "x" "y" {\n-  a = 1\n+  a = 2\n }\n and some more lines of text'


def reasons(df):
    return {(r.repo, r.file): r.reason for r in H.classify_files(df).collect()}


def test_reasons(mined):
    rows = [
        ("o_a_00000001", "src/main.tf", CODE, None),
        ("o_a_00000001", "vendor/x/main.tf", CODE, "path"),
        ("o_a_00000001", "VENDOR\\\\X\\\\y.go", "x", "path"),
        ("o_a_00000001", "vendor-billing/main.tf", "x", None),
        ("o_a_00000001", "vendoring_policy.tf", "x", None),
        ("o_a_00000001", "d/package-lock.json", None, "path"),
        ("o_a_00000001", "d/x.generated.tf", "", "path"),
        ("o_a_00000001", "n1.go", "@@ -9 +9 @@\n // Code generated by tool. DO NOT EDIT.\n+x", "notice"),
        ("o_a_00000001", "n2.json", '{\n  "//": "Arquivo gerado automaticamente por x; y."\n}', "notice"),
        ("o_a_00000001", "n3.py", "# writes the generated suite files for x", None),
        ("o_a_00000001", "n4.py", "# Do not edit the token below without asking x owners", None),
        ("o_a_00000001", "c1.tf", "# Copied unchanged from q/w at v7.5\nx", "copy"),
        ("o_a_00000001", "c2.tf", "# Copied unchanged from o/a at v7.5\nx", None),  # its own repository
        ("o_a_00000001", "c3.tf", "# see also q/w\nx", None),
        ("o_a_00000001", "s/app.js", JS, "minified"),
        ("o_a_00000001", "s/hand.js", "const a = require('b');\n" * 30, None),
        ("o_a_00000001", "b.tf", 'locals {\n  x = "' + "aB3/" * 80 + '"\n}', "blob"),
        ("o_a_00000001", "bytes.py", "@@ -0,0 +1,9 @@\n+KEY = [\n" + "+    0x4b, 0x15, 0x9b, 0x2d, 0xfb,\n" * 9 + "+]", "blob"),
        ("o_a_00000001", "many.json", '{"v": [' + "-0.25, 1e-3," * 100_000 + "1]}", "blob"),
        ("o_a_00000001", "words.txt", "list (" + "dad, bad, fad, " * 40 + ")", None),
        ("o_a_00000001", "few.py", "PORTS = [" + "80, 443, " * 12 + "]", None),
        ("o_a_00000001", "n5.tf", "# == rendered from net.tmpl by stack-tool, edit the template instead", "notice"),
        ("o_a_00000001", "n6.tf", "# rendered from net.tmpl by stack-tool", None),
        ("o_a_00000001", "p.tf", "  policy = jsonencode({Action=[" + '"a:B",' * 60 + "]})", None),
        ("p_b_00000002", "libs/a/src/main.tf", CODE, "copy"),  # the file of o/a
        ("p_b_00000002", "modules/o/a/src/main.tf", CODE, "copy"),
        ("p_b_00000002", "imports/o-a-1.2.3/src/main.tf", CODE, "copy"),
        ("p_b_00000002", "libs/a/other.tf", CODE, None),  # o/a has no such file
        ("o_a_00000001", "libs/a/src/main.tf", CODE, None),  # its own name
    ]
    df = mined([{"repo": r, "commit_hash": "c", "file": f, "patch": p} for r, f, p, _ in rows])
    got = reasons(df)
    for r, f, _, want in rows:
        assert got[(r, f)] == want, (r, f, got[(r, f)])


def test_copies_at_the_root_with_other_line_ends(mined):
    rows = [("o_net_00000001", "main.tf", CODE, None), ("o_net_00000001", "short.tf", "+a = 1", None), ("p_b_00000002", "modules/net/main.tf", CODE.replace("\n", "\r\n"), "copy"), ("p_b_00000002", "net/short.tf", "+a = 1", "copy"), ("p_b_00000002", "net/other.tf", CODE, None)]
    got = reasons(mined([{"repo": r, "commit_hash": "c", "file": f, "patch": p} for r, f, p, _ in rows]))
    assert got == {(r, f): want for r, f, _, want in rows}


def test_attributes_and_mining(mined):
    attrs = "# comment\n*.snap linguist-generated\nlib/** linguist-vendored=true\nlib/own.js -linguist-vendored\nvendor/ok.tf linguist-vendored=false\n\"a b.txt\" linguist-generated=true\n"
    rows = [{"repo": "r", "commit_hash": "c", "file": ".gitattributes", "patch": attrs}, {"repo": "r", "commit_hash": "c", "file": "sub/.gitattributes", "patch": "@@ -0,0 +1,2 @@\n+*.snap !linguist-generated\n-x.js linguist-generated\n"}]
    files = {"a/x.snap": "declared", "sub/y.snap": None, "lib/z.js": "declared", "lib/own.js": None, "vendor/ok.tf": None, "vendor/no.tf": "path", "a b.txt": "declared", "sub/x.js": None}
    rows += [{"repo": "r", "commit_hash": "c", "file": f, "patch": "x"} for f in files]
    rows += [{"repo": f"q{i}", "commit_hash": "c", "file": f"deploy{i}/zz.lst", "patch": "# Code generated by t. DO NOT EDIT."} for i in range(9)]
    rows += [{"repo": "new", "commit_hash": "c", "file": "any/zz.lst", "patch": "hand"}, {"repo": "new", "commit_hash": "c", "file": "any/zz.txt", "patch": "hand"}]
    got = reasons(mined(rows))
    for f, want in files.items():
        assert got[("r", f)] == want, f
    assert got[("new", "any/zz.lst")] is None  # 9 of 10 is below the precision that mining asks for
    assert reasons(mined([r for r in rows if r["repo"] != "new"] + [{"repo": f"w{i}", "commit_hash": "c", "file": "d/zz.lst", "patch": "# Code generated by t. DO NOT EDIT."} for i in range(40)] + [{"repo": "new", "commit_hash": "c", "file": "any/zz.lst", "patch": "hand"}]))[("new", "any/zz.lst")] == "mined"


def test_attribute_files_change(mined):
    """Rules are those of the file's last state by instants, whatever the order of rows and the style of dates."""
    rows = [
        {"repo": "r", "commit_hash": "c3", "date": "2024-03-01T10:00:00+02:00", "file": ".gitattributes", "patch": "@@ -1,3 +1,2 @@\n *.snap linguist-generated\n-gen/** linguist-generated\n docs/** linguist-vendored\n"},
        {"repo": "r", "commit_hash": "c1", "date": "Mon Jan 1 08:00:00 2024 +0000", "file": ".gitattributes", "patch": "@@ -0,0 +1,2 @@\n+*.snap linguist-generated\n+gen/** linguist-generated\n"},
        {"repo": "r", "commit_hash": "c2", "date": "2024-02-01 23:00:00 -0500", "file": ".gitattributes", "patch": "@@ -2 +2,2 @@\n gen/** linguist-generated\n+docs/** linguist-vendored\n"},
        {"repo": "r", "commit_hash": "c1", "date": "2024-01-01T09:00:00+01:00", "file": ".gitattributes", "patch": "@@ -0,0 +1,2 @@\n+*.snap linguist-generated\n+gen/** linguist-generated\n"},
        {"repo": "gone", "commit_hash": "d1", "date": "2024-01-01T00:00:00Z", "file": "sub/.gitattributes", "patch": "*.x linguist-generated"},
        {"repo": "gone", "commit_hash": "d2", "date": "2024-01-02T00:00:00Z", "file": "sub/.gitattributes", "patch": "@@ -1 +0,0 @@\n-*.x linguist-generated"},
    ]
    rows += [{"repo": r, "commit_hash": "c", "file": f, "patch": "x"} for r, f in (("r", "a.snap"), ("r", "gen/a"), ("r", "docs/a"), ("gone", "sub/a.x"))]
    got = reasons(mined(rows))
    assert [got[k] for k in (("r", "a.snap"), ("r", "gen/a"), ("r", "docs/a"), ("gone", "sub/a.x"))] == ["declared", None, "declared", None]


def test_patches_apply():
    assert H.apply_patch(["a", "b", "c"], "@@ -2,1 +2,2 @@\n-b\n+B\n+b2\n") == ["a", "B", "b2", "c"]
    assert H.apply_patch(["a"], "@@ -9 +9 @@\n-zz\n+new\n@@ -20 +20 @@\n ctx\n") == ["a", "new", "ctx"]
    assert H.apply_patch(["a", "b"], "@@ -1,2 +0,0 @@\n-a\n-b\n\\ No newline") == [] and H.apply_patch(["a"], "b\nc") == ["b", "c"]


def test_patterns_of_declaring_repositories_serve_the_others(mined):
    """300 repositories, two thirds of them with attribute files: what those declare is found in the rest."""
    rows = []
    for i in range(300):
        r = f"o_r{i}_{i:08x}"
        if i % 3:
            rows.append({"repo": r, "commit_hash": "c", "date": "2024-01-01T00:00:00Z", "file": ".gitattributes", "patch": "@@ -0,0 +1,3 @@\n+*.snap.txt linguist-generated\n+autogen/** linguist-generated\n+foreign/** linguist-vendored\n"})
        made = (f"t{i}/a.snap.txt", f"autogen/k{i}.tf", f"x/foreign/k{i}.py") if i % 3 == 0 else (f"t{i}/a.snap.txt", f"autogen/k{i}.tf", f"foreign/k{i}.py")
        rows += [{"repo": r, "commit_hash": "c", "file": f, "patch": "x"} for f in (*made, f"t{i}/a.txt", f"src/k{i}.tf", "main.tf")]
    got = reasons(mined(rows))
    count = {why: sum(v == why for v in got.values()) for why in ("declared", "mined", None)}
    assert count == {"declared": 600, "mined": 300, None: 900 + 200}
    assert all((v == "mined") == ("snap" in f or "autogen" in f or "foreign" in f) for (r, f), v in got.items() if int(r.split("_")[1][1:]) % 3 == 0)


@pytest.mark.parametrize("pattern, directory, path, hit", [
    ("*.js", "", "a/b.js", True), ("*.js", "d", "b.js", False), ("/x.js", "", "x.js", True), ("/x.js", "", "a/x.js", False), ("a/*.c", "", "a/b/x.c", False), ("a/**/x.c", "", "a/x.c", True),
    ("a/**", "", "a/b/c", True), ("**/t", "", "q/t", True), ("f?o", "", "d/fxo", True), ("[ab].c", "", "b.c", True), ("[!ab].c", "", "b.c", False), ("d/", "", "d/x", False), ("a.b", "", "axb", False),
])
def test_globs(pattern, directory, path, hit):
    rx = H.glob_regex(pattern, directory)
    assert bool(rx and re.search(rx, path)) is hit


def test_last_rule_wins():
    got = H.declared_by_rules(pd.Series(["a.js", "b.js", None]), pd.Series([["js$", "a"]] * 3), pd.Series([[1, 0]] * 3))
    assert got.tolist() == [False, True, None]


def test_edges(spark, mined):
    nothing = mined([{}, {"repo": "", "commit_hash": None, "file": "", "patch": ""}, {"repo": None, "file": "vendor/a", "commit_hash": "c"}, {"repo": None, "file": None, "patch": "# @generated by x"}, {"repo": "r", "file": "f", "patch": "y " * 2_000_000}])
    got = reasons(nothing)
    assert got[(None, None)] == "notice" and got[(None, "vendor/a")] == "path" and got[("r", "f")] is None
    assert H.classify_files(nothing.limit(0)).count() == 0
    twice = mined([{"repo": "r", "commit_hash": "c", "file": "vendor/a"}] * 3).withColumns({"rid": F.lit(1), "path": F.lit("x"), "noted": F.lit(True), "reason": F.lit("y")})
    assert [tuple(r) for r in H.classify_files(twice).collect()] == [("r", "c", "vendor/a", "path")]
    # evidence in one record holds for the whole file
    both = mined([{"repo": "r", "commit_hash": "c1", "file": "a.go", "patch": "// Code generated by t. DO NOT EDIT."}, {"repo": "r", "commit_hash": "c2", "file": "a.go", "patch": "x"}])
    assert {r.reason for r in H.classify_files(both).collect()} == {"notice"}
