"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: anything but letters, numbers and the underscore, in all of Unicode.
SEPARATOR = r"[^\p{L}\p{N}_]+"
NGRAM_SIZES = (3, 4, 5)


def tokens(text: Column) -> Column:
    """Lower-case words; a text that begins or ends with a separator has an empty word there."""
    return F.split(F.lower(text), SEPARATOR, -1)


def longer_ngrams(shorter: Column, words: Column, n: int) -> Column:
    """The n-grams of `words`, by start, from its (n-1)-grams."""
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(shorter, F.lit(1), count), F.slice(words, F.lit(n), count), lambda a, b: F.concat(a, F.lit(" "), b))


def hashtag_list(text: Column, none: str = "[]") -> Column:
    """The tags of a printed list such as ['a', 'b']; null for the empty list."""
    bare = F.replace(F.replace(F.btrim(text, F.lit("[]")), F.lit("'"), F.lit("")), F.lit(" "), F.lit(""))
    return F.when(text != none, F.split(bare, ",", -1))


def slug(name: str) -> str:
    """A file-system name (a fixed rule, as stored projects have such names): runs of other characters become one underscore."""
    import re

    return re.sub(r"\W+", "_", name.lower()).strip("_")


def shortened(value, width: int = 20) -> str:
    """A cell of a preview."""
    if value is None:
        return "(N/A)"
    text = str(value)
    return text if len(text) <= width else text[:width] + "..."
