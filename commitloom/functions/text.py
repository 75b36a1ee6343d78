"""Cleaning, classifying and tokenising messages, as pure Column expressions.

Regexes come in two flavours: ``unicode=True`` (the default) treats letters and white
space of any script like Python's ``re`` does, ``unicode=False`` is ASCII only, which
other SQL engines reproduce exactly. Null texts stay null unless said otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of merge messages (to recognise them).
MERGE_FORMS = (
    r"Merge pull request #\d+ from .*",
    r"Merge remote-tracking branch '.*'",
    r"Merge branch '.*'( of .*)?( into .*)?",
    r"\s*Merged in .*",
    r"🔀\s*[Mm]erge pull request from.*",
)
# Forms of merge messages that name a branch (group 1) and maybe a title (group 2).
MERGE_CONTENT = (
    r"^(?:[Mm]erge pull request|🔀\s*[Mm]erge pull request) #?\d* from [^/]+/([^\n]+)(?:\n\n(.+))?$",
    r"^[Mm]erge branch '([^']+)'",
    r"^[Mm]erge remote-tracking branch '([^']+)'",
)
# Words that mark a correction, as substrings.
FIX_KEYWORDS = ("fix", "bug", "issue", "resolve", "error", "failure", "incorrect")
ISSUE = r"(\s|^)(#|GH-)\d+\b"
URL = r"https?://\S+"
#: A run of visible characters with an at sign inside: looked for at its start only, so long runs are read once.
ADDRESS = r"(?<!\S)\S[^\s@]*+@\S+"


def _u(pattern: str, unicode: bool) -> str:
    return ("(?U)" if unicode else "") + pattern


def strip(text: Column, unicode: bool = True) -> Column:
    """Without white space at both ends (``trim`` alone knows only blanks)."""
    return F.regexp_replace(text, _u(r"^\s+|\s+$", unicode), "")


def first_line(text: Column) -> Column:
    """Up to the first line end of any kind."""
    return F.split(text, r"\r\n|\n|\r")[0]


def clean_basic(message: Column, unicode: bool = True) -> Column:
    """First line, lower case, stripped; empty for null."""
    return strip(F.lower(first_line(F.coalesce(message, F.lit("")))), unicode)


def _tidy(line: Column, max_len: int, unicode: bool) -> Column:
    text = F.lower(F.regexp_replace(line, _u(ISSUE, unicode), " "))
    text = F.regexp_replace(F.regexp_replace(text, _u(URL, unicode), " "), _u(r"\s+", unicode), " ")
    # A longer text ends before the last blank of its first ``max_len`` characters, or with them if there is none.
    cut = rf"(?s)^(?=.{{{max_len + 1}}})(?:(.{{0,{max_len - 1}}}) .*|(.{{{max_len}}}).*)$"
    return F.nullif(F.regexp_replace(F.trim(text), cut, "$1$2"), F.lit(""))


def clean_message(message: Column, max_len: int = 150, unicode: bool = True) -> Column:
    """First line without issue references and links, lower case, single blanks, cut at a word; null if nothing is left."""
    return _tidy(first_line(message), max_len, unicode)


def merge_content(message: Column, unicode: bool = True) -> Column:
    """Branch and title that a merge message names, null for other messages.

    The branch loses dashes, underscores and punctuation; the title follows unless it repeats the branch.
    """
    out = None
    for form in reversed(MERGE_CONTENT):
        rx = "(?s)" + form
        groups = re.compile(form).groups
        branch = F.regexp_replace(F.regexp_extract(message, rx, 1), r"[-_]+", " ")
        branch = F.trim(F.regexp_replace(branch, _u(r"[^\w\s]", unicode), " "))
        title = strip(F.regexp_extract(message, rx, 2), unicode) if groups > 1 else None
        both = F.concat_ws(" ", F.when(F.lower(title) != F.lower(branch), branch), F.nullif(title, F.lit(""))) if groups > 1 else branch
        out = F.when(message.rlike(rx), both) if out is None else F.when(message.rlike(rx), both).otherwise(out)
    return out


def clean_message_semantic(message: Column, max_len: int = 150, unicode: bool = True) -> Column:
    """As :func:`clean_message`, but merge messages are represented by the branch and title they name."""
    return _tidy(F.coalesce(F.nullif(merge_content(message, unicode), F.lit("")), first_line(message)), max_len, unicode)


def is_merge(message: Column) -> Column:
    """Whether a message has the form of a merge; false for null."""
    return F.coalesce(message.rlike("(?i)^(?:" + "|".join(MERGE_FORMS) + ")"), F.lit(False))


def is_generic_merge(message: Column, cleaned: Column) -> Column:
    """A merge whose cleaned text says nothing but that it is one."""
    return is_merge(message) & F.coalesce(cleaned.rlike(r"^(?:merge (?:pull request|branch)|$)"), F.lit(True))


def has_keyword(message: Column, keywords: tuple[str, ...] = FIX_KEYWORDS) -> Column:
    """Whether any keyword occurs anywhere in the message, in any case; no keywords match nothing."""
    low = F.lower(message)
    found = F.lit(False)
    for k in keywords:
        found = found | F.coalesce(F.contains(low, F.lit(k.lower())), F.lit(False))
    return found


def is_bugfix(message: Column) -> Column:
    """Whether a word of the message starts with a word of correction."""
    return F.coalesce(message.rlike(r"(?i)\b(fix|bug|resolv|crash|error|issue|incorrect)"), F.lit(False))


def has_url(text: Column) -> Column:
    return F.coalesce(text.rlike(URL), F.lit(False))


def has_issue_ref(text: Column) -> Column:
    return F.coalesce(text.rlike(ISSUE), F.lit(False))


def has_emoji(text: Column) -> Column:
    """Pictographs, symbols, dingbats, flags and emoji modifiers."""
    return F.coalesce(text.rlike(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23FA}\x{1F1E6}-\x{1F1FF}]"), F.lit(False))


def has_prefix(cleaned: Column, kind: str) -> Column:
    """A conventional prefix ``kind:`` or ``kind(``."""
    return F.coalesce(cleaned.startswith(f"{kind}:") | cleaned.startswith(f"{kind}("), F.lit(False))


def words(text: Column, unicode: bool = True) -> Column:
    """The parts between white space; an empty array for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _u(r"\s+", unicode)), lambda t: t != "")


def word_count(text: Column, unicode: bool = True) -> Column:
    return F.size(words(text, unicode))


def content_words(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-case words of letters and digits, longer than one, not all digits, not stop words."""
    stops = F.array(*[F.lit(s) for s in stop_words]) if stop_words else F.array().cast("array<string>")
    return F.filter(
        words(F.lower(text)), lambda t: (F.length(t) > 1) & t.rlike(r"^[\p{L}\p{N}]+$") & ~t.rlike(r"^\p{Nd}+$") & ~F.array_contains(stops, t)
    )


def keyword_text(text: Column) -> Column:
    """English text ready for keyword extraction: no links, references, sign-offs, addresses or punctuation."""
    t = F.lower(text)
    for rx in (URL, r"(\s|^)(#|gh-|issue-|jira-)\d+\b", r"(?:signed-off|co-authored)-by:.*?<.*?>", ADDRESS, r"[^a-z0-9\-\s]"):
        t = F.regexp_replace(t, rx, " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def lemma(token: Column) -> Column:
    """A rule-based English base form: plurals, -ing and -ed endings."""
    t = F.when((F.length(token) > 4) & token.rlike("ies$"), F.regexp_replace(token, "ies$", "y"))
    t = t.when((F.length(token) > 4) & token.rlike("(ss|x|ch|sh|z)es$"), F.regexp_replace(token, "es$", ""))
    t = t.when((F.length(token) > 3) & token.rlike("[^su]s$"), F.regexp_replace(token, "s$", ""))
    t = t.when((F.length(token) > 5) & token.rlike("([b-df-hj-np-tv-z])\\1ing$"), F.regexp_replace(token, "([b-df-hj-np-tv-z])\\1ing$", "$1"))
    t = t.when((F.length(token) > 5) & token.rlike("ing$"), F.regexp_replace(token, "ing$", ""))
    t = t.when((F.length(token) > 4) & token.rlike("([b-df-hj-np-tv-z])\\1ed$"), F.regexp_replace(token, "([b-df-hj-np-tv-z])\\1ed$", "$1"))
    return t.when((F.length(token) > 4) & token.rlike("ed$"), F.regexp_replace(token, "ed$", "")).otherwise(token)


def terms(text: Column, stop_words: tuple[str, ...] = (), lemmatise: bool = False) -> Column:
    """Keyword candidates of a text; an empty array for null."""
    stops = F.array(*[F.lit(s) for s in stop_words]) if stop_words else F.array().cast("array<string>")
    parts = F.split(F.coalesce(keyword_text(text), F.lit("")), " ")
    if lemmatise:
        parts = F.transform(parts, lemma)
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.rlike(r"^\d+$") & ~t.startswith("-") & ~F.array_contains(stops, t))


def truncate(text: Column, n: int) -> Column:
    """At most ``n`` characters, followed by ``...`` where something is missing."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def highlight(text: Column, term: Column) -> Column:
    """Words that start with ``term``, in any case, between double asterisks."""
    safe = F.regexp_replace(term, r"([\\\[\](){}.*+?^$|-])", r"\\$1")
    return F.regexp_replace(text, F.concat(F.lit(r"(?i)(\b"), safe, F.lit("[a-z]*)")), F.lit("**$1**"))


def percent(share: Column) -> Column:
    """``12.34%``."""
    return F.format_string("%.2f%%", share * 100)


# Frequent function words that tell languages apart.
LANGUAGE_WORDS = {
    "en": tuple("the and of to is for with that this from when not on are be it was as at by an if has have will can but or we you they which there all should does did been into after before only also its their so than then more each where how what no in".split()),
    "pt": tuple("o a e de que não uma para com em do da os por mais no na um se as dos das ao aos é são foi ser está como mas ou quando antes depois sem sobre já também pela pelo nos nas esta este isso essa esse ele ela nossa nosso cada sempre ainda à às até muito só tem".split()),
    "es": tuple("el de que no una para con en del la los por más las un se es al lo como pero su sus está fue son ser o cuando antes después sin sobre ya también esta este esto esa ese hay desde hasta cada siempre muy nos porque y algo queda le donde entre todo".split()),
    "fr": tuple("le de que ne une pour avec dans du la les par pas des un est et en au aux ce cette ces sur qui sont il elle nous vous se sa son ses mais ou quand avant après sans déjà aussi chaque toujours encore été être à plus leur leurs où si tout".split()),
    "de": tuple("der und die das nicht eine für mit auf den dem ist ein zu von im in sich des es wird werden wurde sind war als auch an bei nach vor aus wenn aber oder noch nur so wie über zum zur einen einem einer sie wir kein keine schon hat haben dass".split()),
}


def language(text: Column) -> Column:
    """The language whose frequent words occur most often, earlier in the list on a tie; ``en`` if none does, null for null."""
    own = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def hits(known: tuple[str, ...]) -> Column:
        return F.size(F.filter(own, lambda t: t.isin(*known)))

    scores = [F.struct(hits(ws).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, ws) in enumerate(LANGUAGE_WORDS.items())]
    return F.when(text.isNotNull(), F.greatest(*scores)["lang"])
