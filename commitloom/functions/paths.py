"""Predicates on file paths, as pure Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories and files that hold no infrastructure of their own.
SIDE_DIRS = ("examples", "example", "test", "tests", "docs", "fixtures", "sample", "mock")
SIDE_FILES = ("example.tf", "test.tf", "tests.tf", "fixture.tf", "sample.tf", "mock.tf")
# Path patterns of files that say nothing about a commit, and extensions by relevance.
EXCLUDED_PATTERNS = ("vendor/", "test/fixtures/", "examples/", "tests/", "testdata/", r"\.github/", "docs/")
EXTENSION_ORDER = (".tf", ".go", ".py", ".yaml", ".yml", ".json", ".sh", ".hcl")


def normalise(path: Column) -> Column:
    """Forward slashes, single, lower case, none at the ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")), "^/|/$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last extension in lower case with its dot; empty for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]*)$", 1))


def is_infra_file(path: Column) -> Column:
    """A ``.tf`` file outside examples, tests, docs and the like; false for null."""
    p = normalise(path)
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    side = F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SIDE_DIRS]))
    return F.coalesce(~name.isin(*SIDE_FILES) & ~side & name.endswith(".tf"), F.lit(False))


def _excluded(file: Column) -> Column:
    return file.rlike("(?i)(?:" + "|".join(EXCLUDED_PATTERNS) + ")")


def any_relevant(files: Column) -> Column:
    """Whether some named file matches no excluded pattern."""
    return F.exists(files, lambda f: f.isNotNull() & ~_excluded(f))


def only_vendor(files: Column) -> Column:
    """Whether there are named files and all of them lie under ``vendor/``."""
    named = F.filter(files, lambda f: f.isNotNull() & (F.trim(f) != ""))
    return (F.size(named) > 0) & F.forall(named, lambda f: F.trim(f).startswith("vendor/"))


def touches_vendor(files: Column) -> Column:
    return F.exists(files, lambda f: F.coalesce(f.rlike("(?i)vendor/"), F.lit(False)))


def clone_directory(full_name: Column) -> Column:
    """Folder of a repository's clone: owner, name cut at 50 characters, eight digits of the full name's MD5."""
    parts = F.split(full_name, "/")
    return F.concat_ws("_", parts[0], F.substring(F.get(parts, F.lit(1)), 1, 50), F.substring(F.md5(full_name), 1, 8))
