"""Term functions, Column to Column: one place for every fold, encoding and local-name rule.

All give null for null. Case folding is lower case with sharp s as "ss"; white space is Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pct_encode(c) -> Column:
    """Percent-encoding of all but unreserved characters (letters, digits, "-", ".", "_", "~")."""
    out = F.url_encode(col(c))
    for old, new in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def pct_decode(c) -> Column:
    """Inverse of pct_encode; a plus sign stays one."""
    return F.url_decode(F.replace(col(c), F.lit("+"), F.lit("%2B")))


def squeeze(c) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def fold(c) -> Column:
    """Case-folded and squeezed: the key by which surface forms are equal."""
    return squeeze(F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss")))


def fold_hyphen(c) -> Column:
    """fold, with hyphens as spaces."""
    return fold(F.replace(col(c), F.lit("-"), F.lit(" ")))


def singular_of(c) -> Column:
    """The key without a final s, for keys of over three characters that do not end in ss; else null."""
    c = col(c)
    return F.when((F.length(c) > 3) & c.endswith("s") & ~c.endswith("ss"), F.substr(c, F.lit(1), F.length(c) - 1))


def abbrev_base(c) -> Column:
    """An abbreviation without its plural s ("ABCs" to "ABC")."""
    return F.regexp_replace(col(c), r"^([A-Z0-9-]{2,})s$", "$1")


def local_name(c) -> Column:
    """What follows the last "#", or else the last "/"."""
    c = col(c)
    return F.when(c.contains("#"), F.substring_index(c, "#", -1)).otherwise(F.substring_index(c, "/", -1))


def fmt_predicate(c) -> Column:
    """A camel-case predicate in lower-case words, without a leading "has "."""
    spaced = F.lower(F.trim(F.regexp_replace(local_name(c), "([A-Z])", " $1")))
    return F.regexp_replace(F.regexp_replace(spaced, r"\s+", " "), "^has ", "")


def compact_predicate(c) -> Column:
    """The last two path segments in lower-case words."""
    parts = F.split(col(c), "/")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), " ")
    camel = F.regexp_replace(tail, "([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(squeeze(F.translate(camel, "_.", "  ")))


#: ASCII punctuation (fixed values).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normalize_answer(c) -> Column:
    """Lower case, without <pad>, ASCII punctuation and articles, squeezed."""
    plain = F.translate(F.replace(F.lower(col(c)), F.lit("<pad>"), F.lit(" ")), PUNCTUATION, "")
    words = F.split(squeeze(plain), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("a", "an", "the") & (w != "")), " ")


def split_answers(c) -> Column:
    """An answer text cut at commas and line ends; trimmed, without empty and repeated parts."""
    parts = F.transform(F.split(col(c), r"\s*[,\n]\s*"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def is_blank(c) -> Column:
    """Null or only white space."""
    c = col(c)
    return c.isNull() | (squeeze(c) == "")


def nt_escape(c) -> Column:
    """A literal's text as N-Triples writes it."""
    out = col(c)
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def nt_unescape(c) -> Column:
    """Inverse of nt_escape."""
    out = F.replace(col(c), F.lit("\\\\"), F.lit("\x00"))
    for old, new in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def half_even(c, digits: int = 6) -> Column:
    """Rounded half to even, as double."""
    return F.bround(col(c).cast("double"), digits)


def stable_rank_key(seed: int, *columns) -> Column:
    """A reproducible random order: the MD5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(col(c).cast("string") for c in columns)))
