"""Column expressions on strings, hashes and numbers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative and absolute tolerance of number comparison.
TOLERANCE = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at its ends (trim takes blanks alone)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def present(c: Column | str) -> Column:
    """The value, or null if it is blank."""
    return F.when(strip(c) != "", col(c))


def first_text(*columns: Column | str) -> Column:
    """First non-blank alias, trimmed; an empty string without one."""
    return F.coalesce(*(strip(present(c)) for c in columns), F.lit(""))


def first_raw(*columns: Column | str) -> Column:
    """First non-blank alias as it is: code keeps its indentation."""
    return F.coalesce(*(present(c) for c in columns), F.lit(""))


def text_list(values: Column | str) -> Column:
    """Trimmed elements that aren't blank."""
    trimmed = F.transform(F.coalesce(col(values), F.array().cast("array<string>")), lambda x: strip(x))
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))


def without(words: Column, common: list[str]) -> Column:
    """Distinct words (none null) that aren't ``common``: a look-up for each word, where array_except would hash the common words for each text."""
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(common)))


def contains_any(text: Column, phrases: list[str]) -> Column:
    """A text holds one of the phrases, to the letter. It is made once, and each phrase is a plain search, where a pattern of all tries each at every character."""
    return F.exists(F.array(text), lambda t: reduce(or_, (t.contains(p) for p in phrases)))


def slug(c: Column | str, length: int = 48) -> Column:
    """Lower-case letters and digits with single underscores between; ``item`` if nothing is left."""
    words = F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}]+", "_")
    cut = F.regexp_replace(F.substring(F.regexp_replace(words, "^_+|_+$", ""), 1, length), "_+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit("item")).otherwise(cut)


def compact(c: Column | str) -> Column:
    """Key of a name: trimmed, lower-case, blanks and hyphens as underscores."""
    return F.translate(F.lower(F.trim(col(c))), " -", "__")


def folded(c: Column | str) -> Column:
    """Text without case and with single blanks."""
    return F.lower(F.trim(F.regexp_replace(col(c), r"\s+", " ")))


def comparable(c: Column | str) -> Column:
    """Text with single blanks, for comparison without regard to white space."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def clean_stdout(c: Column | str) -> Column:
    """Unix line ends, no blanks at line ends, no blank ends."""
    unix = F.regexp_replace(col(c), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(unix, r"[^\S\n]+(?=\n|$)", ""), r"^\s+|\s+$", "")


def stable_repr(c: Column | str) -> Column:
    """Object reprs without module path and address."""
    return F.regexp_replace(col(c), r"<(?:[\w]+\.)*([\w]+) object at 0x[0-9A-Fa-f]+>", "<$1 object>")


def has_unstable_repr(c: Column | str) -> Column:
    return col(c).rlike(r"<[\w.]+ object at 0x[0-9A-Fa-f]+>")


def digest12(c: Column | str) -> Column:
    """First 12 digits of the SHA-256."""
    return F.substring(F.sha2(col(c).cast("binary"), 256), 1, 12)


def redacted(c: Column | str) -> Column:
    """What a log may keep of code or content."""
    return F.struct(digest12(c).alias("sha256"), F.length(col(c)).alias("chars"))


def seed_of(c: Column | str) -> Column:
    """Number of the first eight hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(col(c).cast("binary")), 1, 8), 16, 10).cast("long")


def close(a: Column | str, b: Column | str, tolerance: float = TOLERANCE) -> Column:
    """Equal within the tolerance, relative to the larger or absolute; NaN equals NaN."""
    a, b = col(a), col(b)
    near = F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))
    return F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b)).otherwise((a == b) | near)


def rate(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole, 0 without a whole."""
    value = F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def numbers_in(c: Column | str) -> Column:
    """Number tokens of a text as doubles."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?<![A-Za-z0-9_])[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?"), F.lit(0))
    return F.transform(found, lambda x: x.try_cast("double"))


def code_fence(c: Column | str) -> Column:
    """Content of the first code fence, trimmed; empty without one."""
    return strip(F.regexp_extract(col(c), r"(?is)```(?:python|py|json)?\s*(.*?)```", 1))


def completion_code(c: Column | str) -> Column:
    """Code in a model's completion: the ``final_code`` of a JSON object, else the first fence, else the text."""
    asked = F.get_json_object(F.coalesce(F.nullif(code_fence(c), F.lit("")), col(c)), "$.final_code")
    plain = F.get_json_object(col(c), "$.final_code")
    return F.coalesce(present(plain), present(asked), present(code_fence(c)), strip(c))


def context_summary(c: Column | str, lines: int = 8, chars: int = 480) -> Column:
    """First lines that aren't blank, at most ``chars`` characters."""
    ends = F.transform(F.split(col(c), r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    text = strip(F.array_join(F.slice(F.filter(ends, lambda x: x != ""), 1, lines), "\n"))
    return F.when(F.length(text) > chars, F.concat(F.rtrim(F.substring(text, 1, chars - 3)), F.lit("..."))).otherwise(text)
