"""Column functions: vectors, texts, flags and rounding."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, and the marks of Chinese typography that count with it.
ASCII_MARKS = string.punctuation
CJK_MARKS = "，。！？；：、“”‘’（）《》〈〉【】…—·"
TRUE_WORDS = ["1", "true", "t", "yes", "y"]
MISSING_WORDS = ["", "n/a", "NA", "NaN", "nan"]


def r6(x: Column) -> Column:
    """Rounded to 6 places, halves away from zero, without a negative zero. By products of doubles, as SQL engines do it: decimals are many
    times slower, and round some halves otherwise. Large values are left to them."""
    y = F.abs(x) * 1e6
    t = F.rint(y)
    t = t + F.when(y - t == 0.5, 1.0).otherwise(0.0)
    return F.when(F.abs(x) < 1e9, F.signum(x) * (t / 1e6)).otherwise(F.round(x, 6)) + F.lit(0.0)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def centered(v: Column) -> Column:
    """v less its mean. The mean is bound once, by transform over a one-element array."""
    return F.flatten(F.transform(F.array(total(v) / F.size(v)), lambda m: F.transform(v, lambda x: x - m)))


def l2_normalized(v: Column, eps: float = 1e-12) -> Column:
    """v over its length, which counts as eps at least."""
    return F.flatten(F.transform(F.array(F.greatest(norm(v), F.lit(eps))), lambda n: F.transform(v, lambda x: x / n)))


def unit(v: Column) -> Column:
    """v over its length; a zero vector gives nulls, which spread, as its direction is undefined."""
    return F.flatten(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.try_divide(x, n))))


def bins(v: Column, n: int) -> Column:
    """A flat vector as n rows of equal length."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.slice(v, (b * (F.size(v) / n) + 1).cast("int"), (F.size(v) / n).cast("int")))


def characters(text: Column) -> Column:
    """The distinct characters of a text, none of an empty one."""
    return F.when(F.length(text) > 0, F.array_distinct(F.split(text, ""))).otherwise(F.array().cast("array<string>"))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b| of arrays without repeats; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1.0 - F.size(F.array_intersect(a, b)) / union)


def punctuation_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, ASCII_MARKS + CJK_MARKS, ""))


def as_flag(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(TRUE_WORDS), F.lit(False))


def present(text: Column) -> Column:
    return text.isNotNull() & ~text.isin(MISSING_WORDS)


def chapter_number(marker: Column) -> Column:
    """The number of a marker like CH07; 0 of none."""
    return F.try_element_at(F.transform(F.array(F.coalesce(F.nullif(marker, F.lit("")), F.lit("CH00"))), lambda m: F.substring(m, 3, 9)), F.lit(1)).try_cast("int")


def is_marker(text: Column) -> Column:
    """CH and any digits, nothing else."""
    return F.coalesce(text.rlike(r"^CH\d+$"), F.lit(False))


def is_long_marker(text: Column) -> Column:
    """CH and at least two digits of any script: the stricter rule of manifests."""
    return F.coalesce(text.rlike(r"(?U)^CH\d{2,}$"), F.lit(False))


def gib(size: Column) -> Column:
    """Bytes as GiB with three places."""
    return F.round(size / F.lit(1024.0**3), 3)


def first_of(keys: Column, names: list[str], default: Column | None = None) -> Column:
    """A map's value under the first of the names that it has; the default without any."""
    return F.coalesce(*(F.try_element_at(keys, F.lit(n)) for n in names), F.lit(None) if default is None else default)


def utc_stamp(at: Column | None = None) -> Column:
    """A time (now) in UTC as ISO 8601 with seconds."""
    at = F.current_timestamp() if at is None else at
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def local_stamp(at: Column | None = None) -> Column:
    """A time (now) of the session's zone for folder names."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd_HHmmss")


def number_or_abort(text: Column) -> Column:
    """A text as a number; one that is none stops the query. Null stays null."""
    x = F.trim(text).try_cast("double")
    return F.when(text.isNotNull() & x.isNull(), F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double")).otherwise(x)


def whole_number(text: Column) -> Column:
    """Digits of any script as a whole number, null of other texts."""
    plain = F.trim(text)
    for zero in (0xFF10, 0x660, 0x6F0, 0x966):  # full-width, Arabic, Persian and Devanagari digits
        plain = F.translate(plain, "".join(chr(zero + k) for k in range(10)), "0123456789")
    return F.when(plain.rlike(r"^\d+$"), plain.try_cast("long"))


def chapter_marker(number: Column) -> Column:
    return F.format_string("CH%02d", number)


def whole_number_text(text: Column) -> Column:
    """Whether a trimmed text is all digits, of any script."""
    return F.trim(text).rlike(r"(?U)^\d+$")


def nearly(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def sample_index(seconds: Column, rate: float, n) -> Column:
    """Seconds as a sample number, half to even, within 0 and n."""
    return F.greatest(F.lit(0), F.least(F.rint(seconds * rate).cast("long"), F.lit(n) if isinstance(n, int) else n))
