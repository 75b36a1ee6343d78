"""Telling hand-written source files from generated, minified, vendored ones and data blobs.

Repositories say in ``.gitattributes`` files which paths are generated or vendored.
The current text of each such file is put together from its changes, its globs are
resolved with git's precedence (deeper files win, later lines win), and applied to the
repositories that have them. Path patterns that nearly always are generated or vendored,
in the repositories that declare or among all files whose content decides, are
mined, and applied with a list of conventional ones to the repositories that declare
nothing. Content evidence (generator and copy notices, minified lines, embedded data,
text equal to the same path of another repository) covers what paths cannot tell.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import to_instant
from ..lineage import cut

# Path conventions that public repositories commonly declare in
# attribute files, matched in lower case with forward slashes.
VENDOR_DIRS = ("vendor", "_vendor", "vendors", "node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty", "godeps", ".terraform", "carthage", "pods")
GENERATED_NAMES = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "cargo.lock", "composer.lock", "gemfile.lock", "go.sum",
    ".terraform.lock.hcl", "terraform.tfstate", "terraform.tfstate.backup", "cdk.tf.json", "bundle.js",
)
GENERATED_SUFFIXES = (
    ".min.js", ".min.css", ".js.map", ".css.map", ".pb.go", ".pb.gw.go", "_pb2.py", "_pb2_grpc.py", ".pb.cc", ".pb.h", ".gen.tf", ".gen.go", ".generated.tf", ".generated.go",
    ".auto.gen.tf.json", ".g.dart", ".designer.cs", ".tfplan", ".tfstate",
)
GENERATED_PREFIXES = ("zz_generated",)
# Notices of generators, in the languages of the corpus, within one comment line.
GENERATOR_NOTICES = (
    r"code generated by \S.{0,80}do not edit",
    r"auto-?generated file\b",
    r"auto-?generated: \S",
    r"@generated\b",
    r"generated automatically by \S.{0,120}(?:do not|changes|overwritten)",
    r"this file (?:was|is) (?:created|generated|written) automatically\b",
    r"this file (?:was|is) auto-?(?:matically )?generated\b",
    r"do not (?:modify|edit) by hand\b",
    r"arquivo gerado automaticamente\b",
    r"archivo generado (?:automáticamente )?por \S.{0,80}no modificar",
    r"fichier généré automatiquement\b",
    # any tool's words for what it did, and then for what to do instead of editing
    r"[^\w\n]{0,8}(?:output|rendered|generated|compiled|produced|built|exported|created|written)\b.{0,60}\b(?:of|from|by|with|using)\b.{0,120}"
    r"\b(?:do(?: not|n't) (?:edit|modify|change)|(?:edit|change|modify) the (?:template|source|original|input)|re-?generate|re-?run|(?:lost|overwritten) (?:on|by|when|with)|will be (?:lost|overwritten))",
)
#: Notices of copies, each naming the repository it comes from as its first group.
COPY_NOTICES = (
    r"copied (?:unchanged |verbatim )?from ([\w.-]+/[\w.-]+)",
    r"vendored from ([\w.-]+/[\w.-]+)",
    r"c[óo]pia de ([\w.-]+/[\w.-]+)",
    r"copia (?:exacta )?de ([\w.-]+/[\w.-]+)",
    r"origin: ([\w.-]+/[\w.-]+)@[0-9a-f]{7,40}",
)

#: A comment line's start, after the diff's own first column; JSON has comment keys instead.
_COMMENT = r"(?m)^[-+ ]?[ \t]*(?:#+|//+|/\*+|\*|--|;+|<!--|%+|\"(?://|\$?_?comment|\$?_?note|\$note|__?generated)\"[ \t]*:[ \t]*\")[ \t!*]*"
GENERATOR = "(?iu)" + _COMMENT + "(?:" + "|".join(GENERATOR_NOTICES) + ")"
COPY = "(?iu)" + _COMMENT + "(?:" + "|".join(COPY_NOTICES) + ")"
#: Literals of this many characters, or arrays of this many numbers, are data and not code.
BLOB_CHARS, BLOB_NUMBERS = 240, 40
BLOB = rf"[\"'](?:[A-Za-z0-9+/]{{{BLOB_CHARS},}}={{0,2}}|[0-9a-fA-F]{{{BLOB_CHARS},}})[\"']"
#: Runs of characters that arrays of numbers consist of, diff columns among them (no repeated groups, which need a stack as deep as the text is long).
ARRAY = rf"[\[({{]([\s0-9a-fA-FxXuUlL.,+-]{{{2 * BLOB_NUMBERS - 2},}})"
NUMBER = r"(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfF]{0,3}\s*,"
#: A minified line: this long, with less than this share of white space.
MINIFIED_CHARS, MINIFIED_SPACE = 160, 0.1
MINIFIED_FILE = r"\.(?:js|mjs|cjs|css|html?)$"
#: Mined patterns need this much support and precision.
MIN_REPOS, MIN_FILES, MIN_PRECISION = 3, 8, 0.97


def normal_path(file: Column) -> Column:
    """Forward slashes, single, without a leading ``./`` or slash; case kept."""
    return F.regexp_replace(F.regexp_replace(F.replace(file, F.lit("\\"), F.lit("/")), r"/+", "/"), r"^(?:\./|/)+", "")


def _any(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


def conventional(path: Column) -> Column:
    """Whether a lower-case path follows a conventional pattern of generated or vendored files."""
    dirs = path.rlike(rf"(?:^|/)(?:{_any(VENDOR_DIRS)})/")
    names = path.rlike(rf"(?:^|/)(?:(?:{_any(GENERATED_NAMES)})|(?:{_any(GENERATED_PREFIXES)})[^/]*)$")
    return dirs | names | path.rlike(rf"(?:{_any(GENERATED_SUFFIXES)})$")


# ---- attribute files


def glob_regex(pattern: str, directory: str) -> str | None:
    """The regex (over whole repository paths) of a gitattributes pattern in ``directory``; None for a pattern git ignores.

    A pattern without an inner slash matches base names at any depth below the
    directory, others match from the directory; ``*`` and ``?`` stay within a path
    part, ``**`` crosses parts. Patterns ending in a slash match nothing in git.
    """
    if not pattern or pattern.startswith(("!", "#")) or pattern.endswith("/"):
        return None
    anchored = "/" in pattern
    body, i, p = "", 0, pattern.lstrip("/")
    while i < len(p):
        if p.startswith("**/", i):
            body, i = body + "(?:[^/]+/)*", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            body, i = body + "/.+", i + 3
        elif p[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif p[i] == "?":
            body, i = body + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            inner = p[i + 1 : j].replace("\\", "\\\\")
            body, i = body + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", j + 1
        elif p[i] == "\\" and i + 1 < len(p):
            body, i = body + re.escape(p[i + 1]), i + 2
        else:
            body, i = body + re.escape(p[i]), i + 1
    root = re.escape(directory + "/") if directory else ""
    return "^" + root + ("" if anchored else "(?:.*/)?") + body + "$"


def parse_attributes(text: str, directory: str) -> list[tuple[str, bool | None]]:
    """(regex, value) of the linguist lines of an attributes file, in order.

    ``x``, ``x=true`` give True, ``-x``, ``x=false`` False, ``!x`` None (undeclared
    again). Quoted patterns are unquoted.
    """
    out = []
    for line in re.split(r"\r\n|\n|\r", text or ""):
        line = line.strip()
        m = re.match(r'"((?:[^"\\]|\\.)*)"\s+(.*)$', line) or re.match(r"(\S+)\s+(.*)$", line)
        if not m or line.startswith("#"):
            continue
        rx = glob_regex(m[1], directory)
        for attr in m[2].split():
            a = re.match(r"([-!]?)linguist-(?:generated|vendored)(?:=(\w+))?$", attr)
            if a and rx:
                out.append((rx, None if a[1] == "!" else not (a[1] == "-" or (a[2] or "").lower() in ("false", "0", "no"))))
    return out


def apply_patch(lines: list[str], patch: str) -> list[str]:
    """The lines of a small file after a diff, or those of ``patch`` itself if it is no diff.

    A hunk replaces the place where its old lines stand. If they stand nowhere (the
    history has gaps), its removed lines go wherever they are, and its other lines are added.
    """
    rows = re.split(r"\r\n|\n|\r", patch)
    if not any(r.startswith("@@") for r in rows):
        return rows
    hunks: list[list[str]] = []
    for r in rows:
        if r.startswith("@@"):
            hunks.append([])
        elif hunks and not r.startswith("\\"):
            hunks[-1].append(r)
    at = 0
    for hunk in hunks:
        hunk = hunk[:-1] if hunk and hunk[-1] == "" else hunk
        old = [r[1:] for r in hunk if not r.startswith("+")]
        new = [r[1:] for r in hunk if not r.startswith("-")]
        place = next((i for i in (*range(at, len(lines) - len(old) + 1), *range(min(at, len(lines) - len(old) + 1))) if lines[i : i + len(old)] == old), None) if old else None
        if place is not None:
            lines = lines[:place] + new + lines[place + len(old) :]
            at = place + len(new)
        else:
            gone = {r[1:] for r in hunk if r.startswith("-")}
            lines = [x for x in lines if x not in gone]
            lines += [x for x in new if x not in lines]
            at = len(lines)
    return lines


def _rules_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """One repository's attribute files, as they stand after all changes, as ordered rules: shallow directories first."""
    rules = []
    for path in sorted(pdf["path"].unique(), key=lambda p: (p.count("/"), p)):
        own = pdf[pdf["path"] == path].sort_values(["ts", "commit_hash", "patch"], na_position="first", kind="stable")
        lines: list[str] = []
        for patch in own["patch"]:
            lines = apply_patch(lines, patch)
        rules += parse_attributes("\n".join(lines), path.rpartition("/")[0])
    return pd.DataFrame({"repo": [pdf["repo"].iloc[0]], "rx": [[r[0] for r in rules]], "on": [[{True: 1, False: 0, None: -1}[r[1]] for r in rules]]})


def attribute_rules(mined: DataFrame) -> DataFrame:
    """``repo, rx array<string>, on array<int>``: one row per repository with attribute files, rules in rising precedence.

    Changes apply in the order of their instants (those without one first); repeated
    records apply once.
    """
    own = mined.where(F.col("repo").isNotNull() & (F.col("repo") != "") & F.col("file").rlike(r"(?:^|[/\\])\.gitattributes$") & F.col("patch").isNotNull())
    own = own.select("repo", normal_path(F.col("file")).alias("path"), "commit_hash", F.unix_micros(to_instant(F.col("date").cast("string"))).alias("ts"), "patch")
    own = own.groupBy("repo", "path", "commit_hash", "patch").agg(F.min("ts").alias("ts"))
    return own.groupBy("repo").applyInPandas(_rules_of, "repo string, rx array<string>, on array<int>")


def declared_by_rules(path: pd.Series, rx: pd.Series, on: pd.Series) -> pd.Series:
    """True or False as the last matching rule says, None where none matches."""
    known: dict[tuple, list] = {}
    out = []
    for p, r, o in zip(path, rx, on):
        value = None
        if r is not None and p is not None:
            key = tuple(r)
            rules = known.get(key) or known.setdefault(key, [re.compile(x) for x in key])
            for k in range(len(rules) - 1, -1, -1):
                if rules[k].search(p):
                    value = None if o[k] < 0 else bool(o[k])
                    break
        out.append(value)
    return pd.Series(out, dtype=object)


# ---- other evidence


def _dense(line: Column) -> Column:
    return (F.length(line) >= MINIFIED_CHARS) & (F.regexp_count(line, F.lit(r"\s")) < MINIFIED_SPACE * F.length(line))


def _array_of_numbers(patch: Column) -> Column:
    runs = F.regexp_extract_all(patch, F.lit(ARRAY), F.lit(1))
    commas = lambda x: F.regexp_count(x, F.lit(","))
    return patch.rlike(ARRAY) & F.exists(runs, lambda x: (commas(x) >= BLOB_NUMBERS - 1) & (F.regexp_count(x, F.lit(NUMBER)) == commas(x)))


def _content_evidence(mined: DataFrame) -> DataFrame:
    """Rows with ``path``, own identity, the decisive flags of content and a digest of the patch."""
    path = normal_path(F.col("file"))
    source = F.regexp_extract("patch", COPY, 0)
    origin = F.lower(F.regexp_extract(source, r"(?i)(?:from|de|origin:) ([\w.-]+/[\w.-]+)", 1))
    own = F.lower(F.regexp_replace(F.replace(F.coalesce("repo", F.lit("")), F.lit("_"), F.lit("/")), r"/[0-9a-f]{8}$", ""))
    return mined.select(
        F.nullif(F.col("repo"), F.lit("")).alias("rid"), "repo", "commit_hash", "file", path.alias("path"),
        F.coalesce(F.col("patch").rlike(GENERATOR), F.lit(False)).alias("noted"),
        (F.coalesce((origin != "") & (F.regexp_replace(origin, r"\.+$", "") != own), F.lit(False))).alias("copied"),
        F.coalesce(F.col("patch").rlike(BLOB) | _array_of_numbers(F.col("patch")), F.lit(False)).alias("blob"),
        F.when(F.lower(path).rlike(MINIFIED_FILE), F.coalesce(F.exists(F.split("patch", "\n"), _dense), F.lit(False))).otherwise(False).alias("minified"),
        F.when(F.col("patch").rlike(r"\S"), F.xxhash64(F.regexp_replace("patch", r"\r\n?", "\n"))).alias("digest"),
    )


def _copies_of_other_repositories(files: DataFrame) -> DataFrame:
    """Distinct (rid, path, digest) of files whose path embeds another repository's name above a path that repository has with equal text.

    ``digest`` is null but for rows without a repository, whose ``rid`` is empty. The embedded name is a directory ``name``, ``owner/name`` or ``owner-name-version``;
    the part below it is looked up there by digest and a hash of (name, path).
    """
    texts = files.where(F.col("path").isNotNull() & F.col("digest").isNotNull()).select(F.coalesce("rid", F.lit("")).alias("rid"), "path", "digest").distinct()
    parts = F.split("path", "/")
    seen = texts.where(F.size(parts) > 1).select("rid", "path", "digest", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("i", "seg"))
    name = F.lower(F.regexp_replace("seg", r"-v?\d+\.\d+(?:\.\d+)?$", ""))
    rest = F.array_join(F.slice(parts, F.col("i") + 2, F.size(parts)), "/")
    claims = seen.select("rid", "path", "digest", F.xxhash64(name, rest).alias("place"))
    stem = F.regexp_replace("rid", r"_[0-9a-f]{8}$", "")
    names = F.array_compact(F.array(F.lower(F.get(F.split(stem, "_", 2), F.lit(1))), F.lower(F.replace(stem, F.lit("_"), F.lit("-")))))
    own = texts.where("rid <> ''").select("rid", "path", "digest", F.explode(names).alias("name"))
    # One row a place and text, however many repositories of that name (forks, say) have it.
    originals = own.groupBy("digest", F.xxhash64("name", "path").alias("place")).agg(F.min("rid").alias("low"), F.max("rid").alias("high"))
    return claims.join(originals, ["digest", "place"]).where((F.col("low") != F.col("rid")) | (F.col("high") != F.col("rid"))).select("rid", "path", F.when(F.col("rid") == "", F.col("digest")).alias("digest")).distinct()


def _features(low: Column) -> Column:
    """What patterns are mined of: base name, compound suffix and directories of a lower-case path."""
    name = F.element_at(F.split(low, "/"), -1)
    dirs = F.transform(F.array_distinct(F.array_remove(F.split(F.regexp_extract(low, r"^(.*)/[^/]*$", 1), "/"), "")), lambda x: F.concat(F.lit("D:"), x))
    suffix = F.regexp_extract(name, r"(\.[a-z0-9_]{2,12}\.[a-z0-9]{1,8})$", 1)
    return F.concat(F.array(F.concat(F.lit("B:"), name)), F.when(suffix != "", F.array(F.concat(F.lit("S:"), suffix))).otherwise(F.array().cast("array<string>")), dirs)


def _mined_patterns(decided: DataFrame) -> DataFrame:
    """``pattern`` of base names, compound suffixes and directories that decided files support.

    decided: distinct ``rid, path, machine, declares`` (not null). A pattern needs enough
    repositories, files and precision: among the repositories that declare, where an
    undeclared file is written by hand, or among all files, where one without evidence
    counts against it.
    """
    each = decided.select("rid", "declares", F.col("machine").cast("int").alias("m"), F.explode(_features(F.lower("path"))).alias("pattern"))
    per = each.groupBy("pattern", "rid").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"), F.max("declares").alias("declares"))

    def supported(own: Column) -> Column:
        n, m = F.sum(F.when(own, F.col("n"))), F.sum(F.when(own, F.col("m")))
        return F.coalesce((F.count_if(own & (F.col("m") > 0)) >= MIN_REPOS) & (n >= MIN_FILES) & (m >= MIN_PRECISION * n), F.lit(False))

    return per.groupBy("pattern").agg((supported(F.col("declares")) | supported(F.lit(True))).alias("ok")).where("ok").select("pattern")


def classify_files(mined: DataFrame) -> DataFrame:
    """``repo, commit_hash, file, reason`` of each distinct key; ``reason`` is null for hand-written files.

    mined: ``repo, commit_hash, file, date, patch``. Reasons, the first that holds:
    ``declared`` by attributes, ``path``, ``notice``, ``copy``, ``minified``, ``blob``,
    ``mined`` (in repositories without attribute files). A declaration that a path is not
    generated or vendored wins over paths. Evidence in one record holds for all records of that file in
    its repository; records without a repository or file stand for themselves. Null
    or empty patches leave the path to decide, a null file is never a case unless
    its text says so. Repeated keys give one row; empty tables none. Texts
    of any length are read whole; other columns are ignored whatever their names.
    """
    rows = cut(_content_evidence(mined.select("repo", "commit_hash", "file", "patch")))
    grouped = rows.where(F.col("rid").isNotNull() & F.col("path").isNotNull())
    flags = ["noted", "copied", "blob", "minified"]
    files = grouped.groupBy("rid", "path").agg(*[F.max(f).alias(f) for f in flags])
    copies = cut(_copies_of_other_repositories(rows))
    files = files.join(copies.where("rid <> ''").select("rid", "path", F.lit(True).alias("embedded")), ["rid", "path"], "left")
    rule = F.pandas_udf(declared_by_rules, "boolean")
    rules = attribute_rules(mined)
    declares = F.col("rx").isNotNull()
    known = files.join(rules.withColumnRenamed("repo", "rid"), "rid", "left").withColumn("declared", F.when(declares, rule("path", "rx", "on"))).withColumn("declares", declares).drop("rx", "on")
    content = F.col("noted") | F.col("copied") | F.col("blob") | F.col("minified") | F.coalesce("embedded", F.lit(False))
    known = cut(known.withColumn("conventional", conventional(F.lower("path"))).withColumn("machine", F.coalesce("declared", content | F.col("conventional"))))
    patterns = _mined_patterns(known.select("rid", "path", "machine", "declares"))
    keyed = known.where(~F.col("machine") & ~F.col("declares")).select("rid", "path", F.explode(_features(F.lower("path"))).alias("pattern"))
    by_pattern = keyed.join(patterns, "pattern", "left_semi").select("rid", "path").distinct().withColumn("mined", F.lit(True))
    verdict = known.join(by_pattern, ["rid", "path"], "left").select(
        "rid", "path",
        F.when(F.col("declared"), "declared").when(F.col("conventional") & F.col("declared").isNull(), "path").when(F.col("noted"), "notice")
        .when(F.col("copied") | F.col("embedded"), "copy").when(F.col("minified"), "minified").when(F.col("blob"), "blob").when(F.col("mined"), "mined").alias("reason"),
    )
    key = ["repo", "commit_hash", "file"]
    owned = grouped.join(verdict, ["rid", "path"]).select(*key, "reason")
    # Rows without a repository or file stand for themselves, and meet copies by their text.
    alone = rows.where(F.col("rid").isNull() | F.col("path").isNull())
    unowned = alone.join(copies.where("rid = ''").select("path", "digest", F.lit(True).alias("unowned")), ["path", "digest"], "left")
    reason = (
        F.when(conventional(F.lower("path")), "path").when(F.col("noted"), "notice").when(F.col("copied") | F.col("unowned"), "copy").when(F.col("minified"), "minified").when(F.col("blob"), "blob")
    )
    return owned.unionByName(unowned.select(*key, reason.alias("reason"))).groupBy(*key).agg(F.min("reason").alias("reason"))
