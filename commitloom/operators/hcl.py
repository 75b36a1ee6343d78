"""Terraform configuration: a small HCL parser and the tables made from it.

The parser turns text into nested dicts; blocks nest under their type and labels,
repeated unlabelled blocks become lists, expressions that are no literals keep their
source text. Attributes, references and dependencies are rows, so lookups and change
analysis are joins and filters. Fragments of diffs start and end anywhere: their parser
steps over stray ends and over statements that make no sense, and counts them. Every
step of either parser consumes text, so it ends in time linear in its length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\f\v]+|\#[^\n]*|//[^\n]*)|(?P<nl>\n)|(?P<str>"(?:[^"\\$\n]|\\.|\$(?!\{)|\$\{(?:[^{}"]|"(?:[^"\\\n]|\\.)*"|\{[^{}]*\})*\})*")
    |(?P<num>-?\d+(?:\.\d+)?\b)|(?P<id>[A-Za-z_][\w-]*)|(?P<op>==|!=|<=|>=|&&|\|\||=>|\.\.\.|[-+*/%<>?:!=.,{}\[\]()$&|^~@])""",
    re.X,
)
_HEREDOC = re.compile(r'<<-?[ \t]*"?(\w+)"?[ \t]*\r?\n')
_CLOSERS = {"}": "{", "]": "[", ")": "("}
_REFERENCE = re.compile(r"(?<![\w.\"])((?:data\.)?[A-Za-z][\w-]*\.[A-Za-z_][\w-]*)")
_NOT_RESOURCES = {"var", "local", "module", "each", "count", "self", "path", "terraform", "data"}


class HclError(ValueError):
    """Text that is no HCL."""


Token = tuple[str, str, int, int]


def _tokens(text: str, lenient: bool) -> list[Token]:
    """(kind, text, start, end) of the tokens of a text; ``lenient`` takes what is none as single ``bad`` characters."""
    out: list[Token] = []
    i, open_comment, open_tags = 0, False, set()
    while i < len(text):
        if text.startswith("/*", i) and not open_comment:
            end = text.find("*/", i + 2)
            if end >= 0:
                i = end + 2
                continue
            open_comment = True  # looked for once
        if text.startswith("<<", i) and (m := _HEREDOC.match(text, i)) and m[1] not in open_tags:
            end = re.compile(rf"(?m)^[ \t]*{m[1]}\b").search(text, m.end())
            if end:
                out.append(("heredoc", text[i : end.end()], i, end.end()))
                i = end.end()
                continue
            open_tags.add(m[1])
        m = _TOKEN.match(text, i)
        if not m and not lenient:
            raise HclError(f"unexpected character at {i}")
        end = m.end() if m else i + 1
        if not m or m.lastgroup != "space":
            out.append((m.lastgroup if m else "bad", text[i:end], i, end))
        i = end
    return out


def _partners(toks: list[Token]) -> dict[int, int]:
    """Numbers of the closing tokens of the opening ones that are closed."""
    out: dict[int, int] = {}
    waiting: dict[str, int] = dict.fromkeys("{[(", 0)
    stack: list[int] = []
    for i, (kind, value, _, _) in enumerate(toks):
        if kind != "op":
            continue
        if value in waiting:
            stack.append(i)
            waiting[value] += 1
        elif value in _CLOSERS and waiting[_CLOSERS[value]]:
            while True:  # what is open within stays open
                j = stack.pop()
                waiting[toks[j][1]] -= 1
                if toks[j][1] == _CLOSERS[value]:
                    out[j] = i
                    break
    return out


class _Parser:
    """Recursive descent. ``skipped`` counts what a lenient parser stepped over."""

    def __init__(self, text: str, lenient: bool = False):
        self.text, self.lenient, self.i, self.skipped, self.in_list = text, lenient, 0, 0, 0
        self.toks = _tokens(text, lenient)
        self.partner = _partners(self.toks)

    def peek(self, skip: bool = False) -> Token:
        while skip and self.i < len(self.toks) and self.toks[self.i][0] == "nl":
            self.i += 1
        return self.toks[self.i] if self.i < len(self.toks) else ("end", "", len(self.text), len(self.text))

    def take(self, value: str) -> Token:
        t = self.peek()
        if t[1] != value or t[0] == "end":
            raise HclError(f"expected {value} at {t[2]}")
        self.i += 1
        return t

    def body(self, end: str | None) -> dict[str, Any]:
        out: dict[str, Any] = {}
        while True:
            kind, value, at, _ = self.peek(skip=True)
            if kind == "end":
                if end and not self.lenient:
                    raise HclError("unclosed block")
                self.skipped += bool(end)
                return out
            if value == end and kind == "op":
                self.i += 1
                return out
            start = self.i
            try:
                if kind not in ("id", "str"):
                    raise HclError(f"unexpected {value!r} at {at}")
                self.statement(out)
            except HclError:
                if not self.lenient:
                    raise
                self.skipped += 1
                self.i = max(self.i, start + 1)
                # The rest of the line is left out, with what its brackets hold; an end of a block stays.
                while kind != "op" and self.peek()[0] not in ("nl", "end") and self.peek()[1] != "}":
                    self.i = self.partner.get(self.i, self.i) + 1

    def statement(self, out: dict[str, Any]) -> None:
        name = self.peek()[1].strip('"')
        self.i += 1
        if self.peek()[1] in ("=", ":"):
            self.i += 1
            out[name] = self.expression()
        else:
            path = [name]
            while self.peek()[0] in ("str", "id"):
                path.append(self.peek()[1].strip('"'))
                self.i += 1
            self.take("{")
            self._place(out, path, self._block(self.i - 1))
        if self.peek()[1] == ",":
            self.i += 1

    def _block(self, opened: int) -> dict[str, Any]:
        if self.in_list and opened not in self.partner:
            raise HclError("unclosed block in a list")
        return self.body("}")

    def _place(self, out: dict[str, Any], path: list[str], inner: dict[str, Any]) -> None:
        for part in path[:-1]:
            out = out.setdefault(part, {})
            if not isinstance(out, dict):
                raise HclError(f"{part} is an attribute and a block")
        last = path[-1]
        if last in out:
            out[last] = [*out[last], inner] if isinstance(out[last], list) else [out[last], inner]
        else:
            out[last] = inner

    def expression(self) -> Any:
        first = self.i
        kind, value, start, _ = self.peek()
        if kind in ("nl", "end") or kind == "op" and (value in _CLOSERS or value == ","):
            raise HclError(f"missing value at {start}")
        after = self.toks[first + 1] if first + 1 < len(self.toks) else ("end", "", 0, 0)
        if after[0] in ("nl", "end") or after[1] in (",", "}", "]"):
            known, literal = _literal(kind, value)
            if known:
                self.i += 1
                return literal
        if kind == "heredoc":
            self.i += 1
            return value.split("\n", 1)[1].rsplit("\n", 1)[0] if value.count("\n") > 1 else ""
        if value in ("{", "[") and not self._is_for() and (first in self.partner or value == "{"):
            self.i += 1
            try:
                return self._block(first) if value == "{" else self._items(self.partner[first])
            except HclError:
                if not self.lenient or first not in self.partner:
                    raise
                self.skipped += 1
                self.i = self.partner[first] + 1
                return self.text[start : self.toks[self.partner[first]][3]].strip()
        return self._source()

    def _items(self, end: int) -> list[Any]:
        items: list[Any] = []
        self.in_list += 1
        try:
            while self.peek(skip=True) and self.i < end:
                items.append(self.expression())
                if self.peek(skip=True)[1] == ",":
                    self.i += 1
                elif self.i < end:
                    raise HclError(f"expected , at {self.peek()[2]}")
        finally:
            self.in_list -= 1
        self.i = end + 1
        return items

    def _source(self) -> str:
        """The text of an expression, over lines only within brackets."""
        start, stop = self.peek()[2], self.peek()[2]
        while True:
            kind, value, at, end = self.peek()
            if kind in ("nl", "end") or kind == "op" and (value == "," or value in _CLOSERS):
                break
            if kind == "op" and value in "{[(":
                if self.i not in self.partner:
                    raise HclError(f"unclosed {value} at {at}")
                self.i = self.partner[self.i]
                end = self.toks[self.i][3]
            self.i += 1
            stop = end
        return self.text[start:stop].strip()

    def _is_for(self) -> bool:
        j = self.i + 1
        while j < len(self.toks) and self.toks[j][0] == "nl":
            j += 1
        return j < len(self.toks) and self.toks[j][1] == "for"


def _literal(kind: str, value: str) -> tuple[bool, Any]:
    """(whether a token is a literal, its value)."""
    if kind == "str":
        return True, json.loads(value) if "${" not in value and _json_string(value) else value[1:-1]
    if kind == "num":
        return True, float(value) if "." in value else int(value)
    return (True, {"true": True, "false": False, "null": None}[value]) if value in ("true", "false", "null") else (False, None)


def _json_string(value: str) -> bool:
    try:
        json.loads(value)
        return True
    except ValueError:
        return False


def parse(text: str) -> dict[str, Any]:
    """The nested dict of an HCL text; HclError if it is none."""
    return _Parser(text or "").body(None)


def parse_snippet(text: str | None) -> dict[str, Any]:
    """As :func:`parse`, but an empty dict for anything that does not parse."""
    try:
        return parse(text or "")
    except (HclError, RecursionError):
        return {}


def new_side(fragment: str | None) -> str:
    """The text after a diff fragment: removed lines and headers left out, diff columns dropped."""
    return _side(fragment, "-", "+")


def old_side(fragment: str | None) -> str:
    """The text before a diff fragment."""
    return _side(fragment, "+", "-")


def _side(fragment: str | None, other: str, own: str) -> str:
    lines = (fragment or "").split("\n")
    return "\n".join(x[1:] if x[:1] in (own, " ") else x for x in lines if not x.startswith((other, "@@", "\\", own * 3)))


def parse_fragment(text: str | None) -> tuple[dict[str, Any], str, int]:
    """(tree, status, places stepped over) of a text that may start and end anywhere.

    Status: ``empty`` for no text, ``whole``, ``partial`` if something was stepped over,
    ``failed`` if nothing is left.
    """
    if not (text or "").strip():
        return {}, "empty", 0
    try:
        parser = _Parser(text, lenient=True)
        tree = parser.body(None)
    except RecursionError:
        return {}, "failed", 1
    return tree, ("failed" if parser.skipped and not tree else "partial" if parser.skipped else "whole"), parser.skipped


def flatten(tree: Any, path: str = "") -> Iterator[tuple[str, Any]]:
    """(path, value) of every attribute; list items of blocks are numbered."""
    if isinstance(tree, dict):
        for k, v in tree.items():
            own = f"{path}.{k}" if path else k
            if isinstance(v, dict):
                yield from flatten(v, own)
            elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
                for i, x in enumerate(v):
                    yield from flatten(x, f"{own}.{i}")
            else:
                yield own, v


def references(value: Any) -> list[str]:
    """Resource addresses (``type.name``) in an expression, without variables, locals and the like."""
    text = value if isinstance(value, str) else json.dumps(value)
    found = []
    for m in _REFERENCE.finditer(re.sub(r'\$\{|"', " ", text) if "${" in text or isinstance(value, list) else text):
        kind, _, rest = m[1].partition(".")
        if rest in ("value", "key"):  # the iterator of a dynamic block
            continue
        if kind not in _NOT_RESOURCES and "_" in kind or m[1].startswith("data."):
            found.append(m[1])
    return list(dict.fromkeys(found))


def _trees(texts: pd.Series, side: str) -> Iterator[tuple[dict[str, Any], str, int]]:
    for text in texts:
        if side == "all":
            tree = parse_snippet(text)
            yield tree, "whole" if tree else "failed" if (text or "").strip() else "empty", 0
        else:
            yield parse_fragment(new_side(text) if side == "new" else old_side(text))


def _rows(key: list[str], column: str, side: str):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            at, path, value, refs = [], [], [], []
            for i, (tree, _, _) in enumerate(_trees(pdf[column], side)):
                for p, v in flatten(tree):
                    at.append(i)
                    path.append(p)
                    value.append(json.dumps(v, ensure_ascii=False))
                    refs.append(references(v))
            out = pdf.iloc[at][key].reset_index(drop=True)
            yield out.assign(**{k: pd.Series(v, index=out.index, dtype=object) for k, v in (("path", path), ("value", value), ("refs", refs))})

    return run


def _kept(df: DataFrame, key: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in key)


def attributes(df: DataFrame, key: list[str], column: str, side: str = "all") -> DataFrame:
    """``key, path, value (JSON), refs`` of every attribute of each text.

    ``side``: ``all`` reads whole texts, and those that don't parse give no rows; ``new``
    and ``old`` read that side of diff fragments, and what makes no sense is left out.
    :func:`parse_status` tells which texts lost something.
    """
    return df.select(*key, column).mapInPandas(_rows(key, column, side), f"{_kept(df, key)}, path string, value string, refs array<string>")


def parse_status(df: DataFrame, key: list[str], column: str, side: str = "all") -> DataFrame:
    """``key, status, skipped, n_attributes``: one row a text, whether all of it could be read."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            done = [(status, skipped, sum(1 for _ in flatten(tree))) for tree, status, skipped in _trees(pdf[column], side)]
            yield pdf[key].assign(**{name: [d[k] for d in done] for k, name in enumerate(("status", "skipped", "n_attributes"))})

    return df.select(*key, column).mapInPandas(run, f"{_kept(df, key)}, status string, skipped int, n_attributes int")


def to_json(df: DataFrame, key: list[str], column: str, side: str = "all") -> DataFrame:
    """``key, tree``: the nested dict of each text as JSON."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf[key].assign(tree=[json.dumps(tree, ensure_ascii=False) for tree, _, _ in _trees(pdf[column], side)])

    return df.select(*key, column).mapInPandas(run, f"{_kept(df, key)}, tree string")


def attribute_by_path(attrs: DataFrame, path: str) -> DataFrame:
    """The rows of one attribute (``resource.TYPE.NAME.ATTRIBUTE``), or of everything below a block."""
    return attrs.where((F.col("path") == path) | F.col("path").startswith(path + "."))


def dependencies(attrs: DataFrame, key: list[str]) -> DataFrame:
    """``key, src, dst``: resources and the resources they refer to, by interpolation or ``depends_on``."""
    src = F.regexp_extract("path", r"^resource\.([^.]+\.[^.]+)", 1)
    return attrs.select(*key, src.alias("src"), F.explode("refs").alias("dst")).where("src <> '' AND src <> dst").distinct()


def depends_on(edges: DataFrame, address: str, transitive: bool = False) -> DataFrame:
    """``dst``: what a resource depends on; with ``transitive`` over any number of steps."""
    found = edges.where(F.col("src") == address).select("dst").distinct()
    if not transitive:
        return found
    found = newest = cut(found)
    while not newest.isEmpty():
        newest = cut(edges.join(newest.select(F.col("dst").alias("src")), "src").select("dst").distinct().join(found, "dst", "left_anti"))
        found = cut(found.union(newest))
    return found


def dependents_of(edges: DataFrame, address: str) -> DataFrame:
    """``src``: the resources that depend on one."""
    return edges.where(F.col("dst") == address).select("src").distinct()


def attribute_changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``key, path, change, old_value, new_value`` of attributes that were added, removed or modified."""
    o, n = old.select(*key, "path", F.col("value").alias("old_value")), new.select(*key, "path", F.col("value").alias("new_value"))
    both = o.join(n, [*key, "path"], "full_outer")
    change = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") != F.col("new_value"), "modified")
    return both.select(*key, "path", change.alias("change"), "old_value", "new_value").where(F.col("change").isNotNull())


def dependency_changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``key, src, dst, change`` of the dependencies that were added or removed, from the attributes of both sides."""
    o, n = dependencies(old, key).withColumn("__o", F.lit(True)), dependencies(new, key).withColumn("__n", F.lit(True))
    both = o.join(n, [*key, "src", "dst"], "full_outer").where("__o IS NULL OR __n IS NULL")
    return both.select(*key, "src", "dst", F.when(F.col("__o").isNull(), "added").otherwise("removed").alias("change"))


def resources(attrs: DataFrame, key: list[str]) -> DataFrame:
    """``key, resource_type, address, count, for_each, n_attributes`` of each resource.

    ``count`` is the JSON of its count; ``for_each`` maps the entries of its for_each to
    their JSON, under the key ``""`` if it is an expression.
    """
    rows = attrs.where(F.col("path").startswith("resource.")).withColumn("__p", F.split("path", r"\."))
    rows = rows.where(F.size("__p") > 3).withColumns({"resource_type": F.col("__p")[1], "address": F.concat_ws(".", F.col("__p")[1], F.col("__p")[2]), "__a": F.col("__p")[3]})
    entry = F.struct(F.array_join(F.slice("__p", 5, F.size("__p")), ".").alias("k"), F.col("value").alias("v"))
    entries = F.array_sort(F.collect_set(F.when(F.col("__a") == "for_each", entry)))
    distinct = F.filter(entries, lambda x, i: (i == 0) | (x["k"] != F.get(entries, i - 1)["k"]))
    return rows.groupBy(*key, "resource_type", "address").agg(
        F.max(F.when((F.col("__a") == "count") & (F.size("__p") == 4), F.col("value"))).alias("count"), F.map_from_entries(distinct).alias("for_each"), F.count(F.lit(1)).alias("n_attributes"),
    )


def dynamic_blocks(attrs: DataFrame, key: list[str]) -> DataFrame:
    """``key, owner, path`` of the dynamic blocks of resources."""
    m = F.regexp_extract("path", r"^(.*\.dynamic\.[^.]+)", 1)
    return attrs.select(*key, F.regexp_extract("path", r"^(.*)\.dynamic\.", 1).alias("owner"), m.alias("path")).where("path <> ''").distinct()


def attribute_usage(attrs: DataFrame, resource_type: str | None = None) -> DataFrame:
    """``resource_type, attribute, n``: how often each attribute is set, optionally of one type."""
    parts = F.split("path", r"\.")
    rows = attrs.where(F.col("path").startswith("resource.")).select(F.get(parts, F.lit(1)).alias("resource_type"), F.get(parts, F.lit(3)).alias("attribute")).where("attribute IS NOT NULL")
    if resource_type:
        rows = rows.where(F.col("resource_type") == resource_type)
    return rows.groupBy("resource_type", "attribute").agg(F.count(F.lit(1)).alias("n"))
