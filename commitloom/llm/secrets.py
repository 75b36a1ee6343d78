"""Finding and masking credentials in source and configuration files.

Each batch of patches gets a trigram index; every detector's required trigrams are
derived from its regex, their posting lists are intersected, and the regex itself
runs on the remaining candidates only. The shards of the index live and die within
a task, so nothing but findings leaves it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .trigrams import Index, holds, required, trigrams_of

#: Characters of text indexed at once; a longer text is indexed in pieces that end with lines, and finds the same.
INDEX_CHARS = 4 << 20

# Last parts of names that hold secrets, in the languages of the corpus.
NAME = (
    r"(?:pass(?:word|wd|phrase|wort)?|passwd|pwd|[_-]pw|senha|contrase[nñ]a|clave_api|chave_api|secret(?:_?(?:access)?_?key)?|token|api[_-]?key|apikey|access_?key|auth|bearer|"
    r"signing_?key|shared_?key|licen[cs]e_?key|metrics_?key|private_?key|encryption_?key|account_?key|hmac|psk|key_value|credentials?)"
)
_END = r"[\"'\]]{0,2}[ \t]*(?:=>|:=|=|:)[ \t]*"
_GAP = r"\s(?:\s|(?<=\n)[-+])*"  # white space, over line ends and diff columns too
_EOL = r"[ \t]*\r?\n[-+ ]?"

#: Names of values that are not secrets themselves.
PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.#_-]+|<[^>]*>|\[[^\]]*\]|\{\{.*|%\(?\w+\)?s?%?|(?:to|tb)d[oe]?|none|null|nil|true|false|yes|no|fixme|empty|unset|redacted|masked|hidden|"
    r"(?:change|replace|insert|fill|put|set|add|enter|your|my|example|sample|dummy|fake|test|placeholder|default|some)[-_ ]?(?:me|this|here|in|it)?(?:[-_ ]?(?:your|the|a|my))?(?:[-_ ]?(?:token|password|secret|key|api|value|pass|here))*)$"
)
REFERENCE = re.compile(r"\$\{|\$\(|\{\{|^\$\w+$|^%[A-Z_]+%$|^(?:var|local|data|module|each|self|secrets?|vault|ssm|env|kms|op|ref)[.:+/]|^arn:|^(?:sha\d*|md5)[:-]|^ENC\[|^\$2[aby]\$|^\{(?:SSHA|SHA|MD5|CRYPT)|^https?://[^@]*$|^projects/|^AQICA|^-----BEGIN (?!(?:[A-Z]+ )?PRIVATE)", re.I)


def is_literal(value: str) -> bool:
    """Whether a value is a secret written out, not a placeholder, reference, word or encrypted text."""
    if len(value) < 5 or PLACEHOLDER.match(value) or REFERENCE.search(value) or re.search(r"\s", value):
        return False
    kinds = sum(bool(re.search(c, value)) for c in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w.\-/]"))
    return kinds >= 2 and len(set(value)) > 3


def _always(value: str) -> bool:
    return not PLACEHOLDER.match(value)


@dataclass(frozen=True)
class Detector:
    """A regex whose group ``s`` is the secret, and a check of what it caught."""

    kind: str
    regex: str
    check: object = _always
    lines: bool = True  # whether a match lies within one line


DETECTORS = (
    Detector("key_id", r"(?<![A-Za-z0-9])(?P<s>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
    Detector("private_key", r"(?P<s>-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----(?:[^-]|-(?!----)|(?<=\n)-)*(?:-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----)?)", lines=False),
    Detector("service_token", r"(?<![\w])(?P<s>(?:gh(?:p|o|u|s|r)_[A-Za-z0-9]{30,}|github_pat_\w{22,}|glpat-[\w-]{18,}|xox(?:a|b|e|p|r|s)-[\w-]{10,}|npm_[A-Za-z0-9]{30,}|dop_v1_[0-9a-f]{40,}|hvs\.[\w-]{20,}|AIza[\w-]{30,}|(?:s|r)k_live_\w{16,}|SG\.[\w-]{16,}\.[\w-]{16,}))"),
    Detector("jwt", r"(?<![\w-])(?P<s>eyJ[\w-]{6,}\.eyJ[\w-]{6,}\.[\w-]{10,})"),
    Detector("url", r"(?<![\w])[a-z][a-z0-9+.-]{1,20}://[^\s:@/\"'<>]*:(?P<s>[^\s@/\"'<>]{3,})@", lambda v: not REFERENCE.search(v) and not PLACEHOLDER.match(v) and not v.startswith("$")),
    Detector("basic_auth", rf"(?i)authorization[\"']?(?:{_GAP})?[:=](?:{_GAP})?[\"']?basic{_GAP}(?P<s>[A-Za-z0-9+/]{{8,}}={{0,2}})", is_literal, lines=False),
    Detector("bearer_auth", rf"(?i)authorization[\"']?(?:{_GAP})?[:=](?:{_GAP})?[\"']?(?:bearer|token){_GAP}(?P<s>[\w.+/=-]{{12,}})", is_literal, lines=False),
    Detector("command", r"\bcurl\b(?:(?!\bcurl\b)[^\n])*?\s(?:-u|--user)[ =]?[\"']?[\w.@-]+:[\"']?(?P<s>[^\s\"']{4,})", is_literal),
    Detector("command", r"\bsshpass\s+-p\s*[\"']?(?P<s>[^\s\"']{4,})", is_literal),
    Detector("command", r"\b(?:mysql|mysqldump|mysqladmin)\b(?:(?!\bmysql)[^\n])*?\s-p[\"']?(?P<s>[^\s\"']{4,})", is_literal),
    Detector("netrc", rf"\blogin{_GAP}\S+{_GAP}password{_GAP}(?P<s>\S{{4,}})", is_literal, lines=False),
    Detector("webhook", r"(?P<s>https://hooks\.[\w.-]+/services/T\w{6,}/B\w{6,}/\w{12,})"),
    Detector("sas", r"[?&]sig=(?P<s>[\w%+/=-]{16,})"),
    Detector("account_key", r"AccountKey=(?P<s>[A-Za-z0-9+/]{30,}={0,2})"),
    Detector("comment", r"(?im)^[-+ ]?[ \t]*(?:#|//|/\*|\*|--|;|<!--)(?>[^\n]*?\b(?:pass(?:word|wd)?|pwd|pw (?:is|was)|pw ?[:=]|senha|contrase[nñ]a|login|creds?|credentials?|credenciais|secret|token|api key|usu[aá]rio)\b)[^\n]*?[ \t:=/](?P<s>[^\s:=/,;\"'()]{6,})[ \t]*(?:\*/|-->)?[ \t]*\r?$", lambda v: is_literal(v) and bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v)) and not re.match(r"^(?:v?\d[\d.]*\w?|#?\d+|\d{4}-\d\d(?:-\d\d)?\S*)$", v) and bool(re.search(r"[A-Z]|[^\w.\-]", v) or len(v) >= 20)),
    Detector("joined", rf"(?i){NAME}{_END}join\([ \t]*\"\"[ \t]*,[ \t]*\[(?P<s>[^\]\n]{{8,}})\]", lambda v: "var." not in v and "${" not in v and not PLACEHOLDER.match(v.strip("\"' "))),
    Detector("assignment", rf"(?i){NAME}{_END}\"(?P<s>[^\"\n]{{4,}})\"", is_literal),
    Detector("assignment", rf"(?i){NAME}{_END}'(?P<s>[^'\n]{{4,}})'", is_literal),
    Detector("assignment", rf"(?im)^[-+ ]?[ \t]*(?:-[ \t]+)?[\w.-]*{NAME}:[ \t]+(?P<s>[^\s\"'#,{{}}\[\]()<>&*!|%@`][^\s\"',{{}}()]{{4,}})[ \t]*(?:#[^\n]*)?\r?$", lambda v: is_literal(v) and not re.match(r"^[\w-]+(?:\.[\w-]+)+$", v)),
    Detector("environment", rf"(?m)^[-+ ]?[ \t]*(?:export[ \t]+|set[ \t]+|ENV[ \t]+|ARG[ \t]+)?[A-Z0-9_]*(?i:{NAME})=(?P<s>[^\s\"'#][^\s\"']{{4,}})[ \t]*\r?$", is_literal),
    Detector("default", rf"(?i)\bvariable[ \t]+\"[\w.-]*{NAME}\"[ \t]*\{{(?:(?!\bvariable[ \t]+\")[^}}\"]|\"[^\"\n]*\"(?![ \t]*\}}))*?\bdefault[ \t]*=[ \t]*\"(?P<s>[^\"\n]{{4,}})\"", is_literal, lines=False),
    Detector("named_value", rf"(?i)\bname[ \t]*[=:][ \t]*\"?[\w.\[\]-]*(?:{NAME}|secretkey)\"?{_EOL}[ \t]*value[ \t]*[=:][ \t]*\"?(?P<s>[^\"\s]{{4,}})\"?", is_literal, lines=False),
)
CONDITIONS = tuple(required(d.regex) for d in DETECTORS)
COMPILED = tuple(re.compile(d.regex) for d in DETECTORS)


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1]


def findings(text: str, which: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the secrets in a text, apart from each other and in order.

    Of overlapping ones the first detector's in DETECTORS stays. ``which`` holds
    (detector, start, end) of the parts to search, by rising detector; everything by default.
    """
    if which is None:
        starts = _line_starts(text)
        which = [(k, a, b) for k, d in enumerate(DETECTORS) for a, b in (((a, b - 1) for a, b in zip(starts, starts[1:])) if d.lines else [(0, len(text))])]
    spans: list[tuple[int, int, str]] = []  # in order and apart, so a new one only meets its neighbours
    for k, lo, hi in which:
        d = DETECTORS[k]
        for m in COMPILED[k].finditer(text[lo:hi]):
            a, b = m.span("s")
            a, b = a + lo, b + lo
            at = bisect_right(spans, (a, a, ""))
            free = (at == 0 or spans[at - 1][1] <= a) and (at == len(spans) or b <= spans[at][0])
            if free and d.check(m["s"]):
                spans.insert(at, (a, b, d.kind))
    return spans


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by ``REDACTED``, quoted where the span is a list of strings.

    Spans over several lines keep their line ends, diff columns and indents.
    """
    out, at = [], 0
    for a, b, kind in spans:
        _, *rest = re.split(r"(\r?\n|\\n)", text[a:b])
        out += [text[at:a], '"REDACTED"' if kind == "joined" else "REDACTED"]
        for k, part in enumerate(rest):
            out.append(part if k % 2 == 0 else re.sub(r"^([-+ ]?\s*)\S.*$", r"\1REDACTED", part))
        at = b
    return "".join([*out, text[at:]])


def _batches(texts: list[str | None]) -> Iterator[list[int]]:
    """Numbers of the texts, in runs of at most INDEX_CHARS characters; a longer text is a run of its own."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if run and size + len(t or "") > INDEX_CHARS:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(t or "")
    if run:
        yield run


def _pieces(text: str) -> Iterator[tuple[int, str]]:
    """(number of its first line, piece): pieces of whole lines with at most INDEX_CHARS characters, or of one longer line."""
    at, line = 0, 0
    while at < len(text):
        end = text.rfind("\n", at, at + INDEX_CHARS) + 1 if len(text) - at > INDEX_CHARS else len(text)
        if end <= at:
            end = text.find("\n", at) + 1 or len(text)
        piece = text[at:end]
        yield line, piece
        at, line = end, line + piece.count("\n")


def _raw(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def _wanted_in_pieces(text: str, index: Index) -> list[tuple[int, int]]:
    """(detector, line, or -1 for the whole text) that a long text's trigrams leave possible."""
    present: set[bytes] = set()
    wanted, before = [], b""
    for first, piece in _pieces(text):
        raw = _raw(piece)
        index.build([raw])
        present |= index.present()
        seam = before[-2:] + raw[:2]
        present |= {seam[i : i + 3] for i in range(len(seam) - 2)}
        before = raw
        for k, condition in enumerate(CONDITIONS):
            if DETECTORS[k].lines:
                lines = index.candidates(condition, "line")
                # What follows a piece's last line end is the next piece's first line.
                wanted += [(k, first + n) for n in lines.tolist() if n < piece.count("\n") or not piece.endswith("\n")]
    wanted += [(k, -1) for k, condition in enumerate(CONDITIONS) if not DETECTORS[k].lines and holds(condition, present)]
    return sorted(set(wanted))


def _detect(texts: list[str | None], index: Index) -> list[list[tuple[int, int, str]]]:
    """Findings of every text; the index picks the detectors and lines to run them on."""
    out: list[list] = [[] for _ in texts]
    for run in _batches(texts):
        tries: dict[int, list[tuple[int, int]]] = {}
        if len(run) == 1 and len(texts[run[0]] or "") > INDEX_CHARS:
            tries[run[0]] = _wanted_in_pieces(texts[run[0]], index)
        else:
            index.build([_raw(texts[i]) for i in run])
            for k, condition in enumerate(CONDITIONS):
                if DETECTORS[k].lines:
                    lines = index.candidates(condition, "line")
                    where = index.text_of[lines]
                    for c, n in zip(where.tolist(), (lines - index.first[where]).tolist()):
                        tries.setdefault(run[c], []).append((k, n))
                else:
                    for c in index.candidates(condition, "text").tolist():
                        tries.setdefault(run[c], []).append((k, -1))
        for i, wanted in tries.items():
            text = texts[i]
            if text:
                starts = _line_starts(text)
                out[i] = findings(text, [(k, 0, len(text)) if n < 0 else (k, starts[n], starts[n + 1] - 1) for k, n in wanted])
    return out


def _new_index() -> Index:
    return Index(sorted(set().union(*(trigrams_of(c) for c in CONDITIONS))))


def find_secrets(mined: DataFrame, text: str = "patch", keys: tuple[str, ...] = ("repo", "commit_hash", "file")) -> DataFrame:
    """Distinct ``keys..., line_no, kind`` of the places where a literal credential starts in ``text``.

    Lines count from 1 and end at line feeds; a credential over several lines is one
    place, at its first line; two of one kind in a line are one row. Null and empty
    texts have none; null keys are kept; other columns are ignored whatever their
    names; texts of any length are searched whole; an empty table gives no rows.
    """
    own = list(keys)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _new_index()
        for batch in it:
            texts = batch.column("__text").to_pylist()
            at, lines, kinds = [], [], []
            for i, spans in enumerate(_detect(texts, index)):
                if spans:
                    ends = [m.start() for m in re.finditer("\n", texts[i])]
                    for a, _, kind in spans:
                        at.append(i)
                        lines.append(bisect_right(ends, a - 1) + 1)
                        kinds.append(kind)
            kept = batch.select(own).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lines, pa.int32()), pa.array(kinds, pa.string())], names=[*own, "line_no", "kind"])

    by_name = {f.name: f for f in mined.schema.fields}
    fields = [*(by_name[k] for k in own), T.StructField("line_no", T.IntegerType()), T.StructField("kind", T.StringType())]
    return mined.select(*own, mined[text].alias("__text")).mapInArrow(run, T.StructType(fields)).distinct()


def redact_secrets(mined: DataFrame, text: str = "patch") -> DataFrame:
    """``mined`` with the secrets of ``text`` masked, and ``secrets_masked`` (their number) added.

    Everything around a secret stays as it is, line ends included. Null and empty
    texts stay; every row is kept, repeated ones too; a column that is already called
    ``secrets_masked`` is replaced.
    """
    kept = [f for f in mined.schema.fields if f.name != "secrets_masked"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _new_index()
        for batch in it:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            found = _detect(texts, index)
            masked = pa.array([mask(t, s) if s else t for t, s in zip(texts, found)], pa.string())
            columns = [masked if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for s in found], pa.int32())], names=[*batch.schema.names, "secrets_masked"])

    return mined.select(*[f.name for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField("secrets_masked", T.IntegerType())]))
