"""Texts that lost their end by a length limit or in transfer.

The corpus vocabulary forms a distributed trie: one row per proper prefix of a known
word. A text's final token that is no known word, or a far rarer one than a word below it,
but a node of that trie was cut inside a word. Words are counted without marks of cutting
and each text's own last token before them, so cut texts do not teach the vocabulary
their stumps. Length evidence finds the limits of the sources
(a length near the top that many different texts share, in characters or bytes); the form
of the ending decides the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

WORD = re.compile(r"[^\W\d_]+")
#: A source has a limit if so many different texts, and this share of them, have its longest length.
LIMIT_TEXTS, LIMIT_SHARE = 3, 0.02
#: A word in so many texts, and this share of all, that ends a sentence or line in less than this share of them leaves one open.
OPEN_TEXTS, OPEN_COMMON, OPEN_SHARE = 12, 0.005, 0.004
#: A last sentence of so many different texts is a phrase and not a stump.
PHRASE_TEXTS = 3
#: A token in at most this share of the texts that a longer word is in, is no word but its stump.
STUMP_SHARE = 0.001

# Marks that mail, log and export tools leave where they cut.
_MARK = re.compile(r"(?i)[ \t]*(?:\((?:cont|contd|continued|cut|truncated|snip|more)\.{0,3}\)?|<(?:snip|cut|truncated|more|clipped)>|\[(?:\.\.\.|…|cut|snip|snipped|truncated|clipped|continued|more|message clipped)\]?)$")
_TRAILER = re.compile(r"^[A-Z][A-Za-z]+(?:-[A-Za-z]+)+: ?")
_GREETING = re.compile(r"(?i)^(?:cheers|(?:best |kind |warm )?regards|best|thanks|thank you|greetings|sincerely|yours|saludos|gracias|abraços|obrigad[oa]|viele grüße|grüße|danke|merci|cordialement)\b[,!]?")
_TERMINAL = re.compile(r"[.!?。！？][\"'”’»)\]*_`]{0,3}$")
_CLOSE = re.compile(r"[.!?;:。！？\r\n]+")
_QUOTES = "\"'”’»)]*_` "
_SENTENCE_END = re.compile(r"[.!?。！？][\"'”’»)\]]?(?=\s|$)")


def ending(text: str) -> tuple[str, str | None, str | None]:
    """(form, final token, last sentence) of a text's end.

    Forms: ``empty``, ``marked`` (a mark of cutting or a damaged last character),
    ``open`` (an unclosed code fence or trailer, or running text without its end),
    ``ellipsis``, ``whole`` (closed by punctuation, bracket or fence), ``title`` (a
    single sentence or title), ``loose`` (a list item, signature, link or the like,
    which need no punctuation).
    """
    t = text.rstrip()
    if not t:
        return "empty", None, None
    if "�" in t[-2:] or _MARK.search(t, max(0, len(t) - 40)):
        return "marked", None, None
    fence = "```" in t and len(re.findall(r"(?m)^[ \t]*```", t)) % 2 == 1
    dots = 3 if t.endswith("...") else 1 if t.endswith("…") else 0
    body = t[: len(t) - dots].rstrip(" \t") if dots else t
    at = len(body)
    while at and body[at - 1].isalpha():
        at -= 1
    token = body[at:] or None
    line = body[max(body.rfind("\n"), body.rfind("\r")) + 1 :].strip()
    ends = [m.end() for m in _SENTENCE_END.finditer(line)]
    last = line[ends[-1] :] if ends and ends[-1] < len(line) else line
    last = re.sub(r"^\W+", "", last)
    if dots:
        return ("open" if fence else "ellipsis"), token, last
    if fence and not line.startswith("```"):
        return "open", token, last
    if _TERMINAL.search(body, max(0, len(body) - 8)) or body.endswith(("`", "}", ")", "]", ">")):
        return "whole", None, last
    trailer = _TRAILER.match(line)
    if trailer:
        return ("open" if "<" in line or "-by:" in line.lower() else "loose"), token, last
    words = len(line.split())
    item = re.match(r"^(?:[-*+•]|\d+[.)])\s+", line)
    if _GREETING.match(line) and words <= 6 or re.search(r"\S+://\S+$", line) or re.search(r"#\d+$", line) or re.match(r"^v?\d+(?:\.\d+)+\S*$", line) or line.startswith("#"):
        return "loose", token, last
    if item:
        rest = line[item.end() :]
        return ("open" if words > 4 else "title") if rest[:1].isupper() else "loose", token, last
    before = body[: len(body) - len(last)]
    return ("open" if _SENTENCE_END.search(before) else "title"), token, last


def _endings(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        ends = [ending(t) if isinstance(t, str) else ("empty", None, None) for t in pdf["text"]]
        yield pdf.drop(columns="text").assign(form=[e[0] for e in ends], token=[e[1] for e in ends], last=[e[2] for e in ends])


def _words(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch: word, texts that have it before their last token, texts where it ends a sentence or line."""
    for pdf in it:
        known: Counter[str] = Counter()
        closing: Counter[str] = Counter()
        for t in pdf["text"]:
            if isinstance(t, str):
                body = t.rstrip()
                mark = _MARK.search(body, max(0, len(body) - 40))
                known.update(set(WORD.findall(body[: mark.start()] if mark else body)[:-1]))
                ends = set()
                for part in _CLOSE.split(t)[:-1]:
                    part = part.rstrip(_QUOTES)
                    at = len(part)
                    while at and part[at - 1].isalpha():
                        at -= 1
                    ends.add(part[at:])
                closing.update(ends)
        words = list(known)
        yield pd.DataFrame({"word": words, "texts": [known[w] for w in words], "closing": [closing[w] for w in words]})


def vocabulary(documents: DataFrame) -> DataFrame:
    """``word, texts, closing`` of every word of all texts, counted batch by batch before the shuffle."""
    parts = documents.where(F.col("text").isNotNull()).select("text").mapInPandas(_words, "word string, texts bigint, closing bigint")
    return parts.groupBy("word").agg(F.sum("texts").alias("texts"), F.sum("closing").alias("closing"))


def trie_nodes(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """``token, below, most``: the wanted tokens that are proper prefixes of known words, with the number of such words and the texts of the most common one."""
    prefix = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.substring("word", F.lit(1), n))
    nodes = words.where(F.length("word") > 1).select("texts", F.explode(prefix).alias("token"))
    return nodes.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("below"), F.max("texts").alias("most"))


def length_limits(rows: DataFrame) -> DataFrame:
    """``source, limit_chars, limit_bytes`` (null where there is none) of each source, from ``source, n_chars, n_bytes, digest``."""
    out = rows.select("source").distinct()
    for n in ("n_chars", "n_bytes"):
        at = rows.groupBy("source", n).agg(F.approx_count_distinct("digest", 0.02).alias("texts"))
        totals = at.groupBy("source").agg(F.sum("texts").alias("all"))
        spike = at.join(totals, "source").where((F.col("texts") >= LIMIT_TEXTS) & (F.col("texts") >= LIMIT_SHARE * F.col("all"))).groupBy("source").agg(F.max(n).alias("limit"), F.max("all").alias("all"))
        above = at.join(spike, "source").groupBy("source").agg(F.max("limit").alias("limit"), F.max("all").alias("all"), F.sum(F.when(F.col(n) > F.col("limit"), F.col("texts")).otherwise(0)).alias("longer"))
        out = out.join(above.where(F.col("longer") <= LIMIT_SHARE * F.col("all")).select("source", F.col("limit").alias("limit_" + n[2:])), "source", "left")
    return out


def find_truncated(documents: DataFrame, forms: bool = True) -> DataFrame:
    """``doc_id, source, truncated, evidence`` of every row of ``documents`` (``doc_id, text, source``).

    evidence, all that hold, joined by plus signs: ``word`` (cut inside a word by the
    trie), ``length`` (at the source's limit), both for texts that are not closed;
    ``mark``, ``open`` (running text, code or trailer without its end; or a final word that
    never ends a sentence), ``ellipsis`` (an ellipsis after something else than a common
    phrase); null for whole texts. Without ``forms``, trie and length alone decide. Null and empty texts are
    whole; rows without a source have no length evidence; repeated rows are judged
    alike; texts of any length are read whole; an empty table gives no rows. Other
    columns are ignored whatever their names.
    """
    kind = documents.schema["doc_id"].dataType
    own = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").cast("string").alias("digest"))
    rows = cut(own.mapInPandas(_endings, "doc_id string, source string, n_chars int, n_bytes int, digest string, form string, token string, last string"))
    words = cut(vocabulary(documents))
    limits = length_limits(rows.where(F.col("source").isNotNull() & F.col("n_chars").isNotNull()))
    finals = rows.where(F.col("token").isNotNull()).select("token").distinct().join(words.withColumnRenamed("word", "token"), "token", "left")
    total = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    stumps = trie_nodes(words, finals.where(F.col("texts").isNull() | (F.col("texts") <= STUMP_SHARE * total)))
    common = (F.col("texts") >= OPEN_TEXTS) & (F.col("texts") >= OPEN_COMMON * total)
    open_word: Column = common & (F.col("closing") < OPEN_SHARE * F.col("texts"))
    judged = finals.join(stumps, "token", "left").select("token", (F.coalesce("texts", F.lit(0)) <= STUMP_SHARE * F.col("most")).alias("stump"), F.coalesce(open_word, F.lit(False)).alias("dangling"))
    phrases = rows.where("form = 'ellipsis'").groupBy("last").agg(F.approx_count_distinct("digest", 0.02).alias("said"))
    # Only loose ends look up their token, and only ellipses their sentence; all other rows get keys that match nothing and spread evenly.
    alone = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("doc_id", "digest"), F.lit(4096)).cast("string"))
    rows = rows.withColumn("token", F.when(F.col("form").isin("whole", "empty", "marked"), alone).otherwise(F.coalesce("token", alone)))
    rows = rows.withColumn("last", F.when(F.col("form") == "ellipsis", F.coalesce("last", alone)).otherwise(alone))
    out = rows.join(judged, "token", "left").join(phrases, "last", "left").join(limits, "source", "left")
    closed = F.col("form").isin("whole", "empty")
    at_limit = F.coalesce(F.col("n_chars") == F.col("limit_chars"), F.lit(False)) | F.coalesce(F.col("n_bytes").between(F.col("limit_bytes") - 3, F.col("limit_bytes")), F.lit(False))
    phrase = F.coalesce(F.col("said") >= PHRASE_TEXTS, F.lit(False))
    stump, dangling = F.coalesce("stump", F.lit(False)), F.coalesce("dangling", F.lit(False))
    clues = {"word": stump & ~closed, "length": at_limit & ~closed}
    if forms:
        clues |= {"mark": F.col("form") == "marked", "open": (F.col("form") == "open") | (dangling & F.col("form").isin("title", "ellipsis")), "ellipsis": (F.col("form") == "ellipsis") & ~phrase}
    evidence = F.nullif(F.concat_ws("+", *[F.when(c, k) for k, c in clues.items()]), F.lit(""))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "source", evidence.isNotNull().alias("truncated"), evidence.alias("evidence"))


def truncation_by_source(found: DataFrame) -> DataFrame:
    """``source, n_docs, n_truncated, share`` of the rows of :func:`find_truncated`; a null source is a group."""
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("truncated").alias("n_truncated")).withColumn("share", F.col("n_truncated") / F.col("n_docs"))
