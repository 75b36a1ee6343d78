"""Counting tokens of a text of any script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace has it; Java's own classes differ on a few controls.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
TOKEN = rf"[{WORD}]+|[^{WORD}{SPACE}]+"
#: The same for Python's re, used inside Arrow stages.
PY_TOKEN = r"\w+|[^\w\s]+"


def token_count(text: Column) -> Column:
    """Tokens of ``text``: runs of letters, digits and underscores, or runs of other visible characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")
