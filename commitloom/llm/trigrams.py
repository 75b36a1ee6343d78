"""A trigram index over chunks of text, and the trigrams a regex requires.

``required`` walks a regex's parse tree and gives a condition on trigrams that every
matching text meets: a nested tuple of ("and", ...), ("or", ...) or a trigram; None
where nothing is required. ``Index`` keeps posting lists of the wanted trigrams over a
batch of texts, with their lines as chunks, and evaluates such conditions by intersecting and uniting them.
Texts and regexes are compared in lower case, on UTF-8 bytes.
"""

from __future__ import annotations

import re._constants as C
import re._parser as P

import numpy as np

#: Alternations with more exact strings than this are no longer followed as strings.
MOST_STRINGS = 40


def _and(parts: list) -> object:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *dict.fromkeys(parts))


def _or(parts: list) -> object:
    if not parts or any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _grams(text: str) -> object:
    raw = text.lower().encode()
    return _and([raw[i : i + 3] for i in range(len(raw) - 2)])


def _walk(items) -> tuple[list[str] | None, object]:
    """(all exact strings the items can match, or None; the condition met by every match)."""
    runs: list[str] | None = [""]
    conditions = []

    def flush() -> None:
        nonlocal runs
        if runs is not None and runs != [""]:
            conditions.append(_or([_grams(r) for r in runs]))
        runs = [""]

    exact = True
    for op, arg in items:
        strings, inner = None, None
        if op is C.LITERAL:
            strings = [chr(arg)]
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            strings = [chr(a) for _, a in arg]
        elif op is C.SUBPATTERN:
            strings, inner = _walk(arg[3])
        elif op is C.ATOMIC_GROUP:
            strings, inner = _walk(arg)
        elif op is C.BRANCH:
            both = [_walk(b) for b in arg[1]]
            if all(s is not None for s, _ in both):
                strings = [x for s, _ in both for x in s]
            inner = _or([c for _, c in both])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            s, inner = _walk(body)
            if low == high == 1:
                strings = s
            elif low == 0 and high == 1 and s is not None:
                strings, inner = ["", *s], None
            elif low == 0:
                inner = None
        elif op in (C.AT, C.ASSERT_NOT, C.ASSERT):
            if op is not C.ASSERT:
                continue
        if strings is not None and runs is not None and len(runs) * len(strings) <= MOST_STRINGS:
            runs = list(dict.fromkeys(r + s for r in runs for s in strings))
        else:
            flush()
            exact = False
            if inner is not None:
                conditions.append(inner)
    whole = runs if exact else None
    if not exact or runs != [""]:
        flush()
    return (list(dict.fromkeys(x.lower() for x in whole)) if whole is not None else None), _and(conditions)


def required(pattern: str) -> object:
    """The trigram condition of a regex, None if a match needs no trigram."""
    return _walk(P.parse(pattern))[1]


def trigrams_of(condition: object) -> set[bytes]:
    """All trigrams in a condition."""
    if condition is None:
        return set()
    return {condition} if isinstance(condition, bytes) else set().union(*(trigrams_of(c) for c in condition[1:]))


def holds(condition: object, present: set[bytes]) -> bool:
    """Whether a text with these trigrams meets a condition."""
    if condition is None or isinstance(condition, bytes):
        return condition is None or condition in present
    return (any if condition[0] == "or" else all)(holds(c, present) for c in condition[1:])


class Index:
    """Posting lists of ``wanted`` trigrams over a batch of texts, by line and by text."""

    def __init__(self, wanted: list[bytes]):
        self.codes = np.array(sorted({(g[0] << 16) | (g[1] << 8) | g[2] for g in wanted}), dtype=np.int64)
        self.known = np.zeros(1 << 24, dtype=bool)
        self.known[self.codes] = True

    def build(self, texts: list[bytes]) -> None:
        """Index lower-cased texts; trigrams never cross from one text into the next."""
        raw = np.frombuffer(b"\x00\n".join(texts) + b"\x00\n", dtype=np.uint8)
        code = (raw[:-2].astype(np.int32) << 16) | (raw[1:-1].astype(np.int32) << 8) | raw[2:]
        at = np.flatnonzero(self.known[code])
        feeds = np.flatnonzero(raw == 10)
        ends = np.cumsum([len(t) + 2 for t in texts])
        line = np.searchsorted(feeds, at)
        gram = np.searchsorted(self.codes, code[at])
        #: Of every line, the text it is in; of every text, its first line.
        self.text_of = np.searchsorted(ends, feeds, side="right")
        self.first = np.searchsorted(self.text_of, np.arange(len(texts)))
        self.sizes = {"line": len(feeds), "text": len(texts)}
        self.posts = {"line": self._post(gram, line, len(feeds)), "text": self._post(gram, self.text_of[line], len(texts))}

    def _post(self, gram: np.ndarray, chunk: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.unique(gram * np.int64(n) + chunk)
        return np.searchsorted(pairs // n, np.arange(len(self.codes) + 1)), pairs % n

    def posting(self, gram: bytes, by: str) -> np.ndarray:
        k = int(np.searchsorted(self.codes, (gram[0] << 16) | (gram[1] << 8) | gram[2]))
        starts, ids = self.posts[by]
        return ids[starts[k] : starts[k + 1]]

    def present(self) -> set[bytes]:
        """The wanted trigrams that occur in the batch."""
        starts, _ = self.posts["text"]
        return {bytes((c >> 16, c >> 8 & 255, c & 255)) for c in self.codes[np.diff(starts) > 0].tolist()}

    def candidates(self, condition: object, by: str = "text") -> np.ndarray:
        """Lines or texts that meet a condition, as rising numbers."""
        if condition is None:
            return np.arange(self.sizes[by])
        if isinstance(condition, bytes):
            return self.posting(condition, by)
        parts = [self.candidates(c, by) for c in condition[1:]]
        if condition[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, p, assume_unique=True)
        return out
