"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that searches ignore.
STOP_WORDS = (
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 它 他 "
    "the a an is are was were be been being have has had do does did will would could should may might must can "
    "of in on at to for with by from as and or not but if then else this that these those it its"
).split()


def tokens(text: Column) -> Column:
    """Search tokens in lower case: words that begin with a letter, then single CJK characters; tags and stop words go."""
    low = F.lower(text)
    # texts without a tag, or of ASCII only, need fewer passes
    plain = F.regexp_replace(F.regexp_replace(low, "<su[pb]>([^<]*)</su[pb]>", "$1"), "</?[a-z][^>]*>", " ")
    low = F.when(low.contains("<"), plain).otherwise(low)
    single = F.when(F.octet_length(low) > F.length(low), F.regexp_extract_all(low, F.lit(r"[\x{4e00}-\x{9fff}]"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    both = F.concat(F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9+\-/]*"), F.lit(0)), single)
    return F.coalesce(F.filter(both, lambda t: ~t.isin(STOP_WORDS)), F.array().cast("array<string>"))


_SCRIPT, _TAG = re.compile("<su[pb]>([^<]*)</su[pb]>"), re.compile("</?[a-z][^>]*>")
_WORD, _SINGLE, _STOP = re.compile(r"[a-z][a-z0-9+\-/]*"), re.compile("[\u4e00-\u9fff]"), frozenset(STOP_WORDS)


def token_list(text: str | None) -> list[str]:
    """The same tokens of one text, for tasks that count them where they are cut."""
    if text is None:
        return []
    low = text.lower()
    if "<" in low:
        low = _TAG.sub(" ", _SCRIPT.sub(r"\1", low))
    found = _WORD.findall(low)
    if not low.isascii():
        found += _SINGLE.findall(low)
    return [t for t in found if t not in _STOP]


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", "")


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or of no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def sentences(text: Column) -> Column:
    """Pieces that end with . ! or ? before white space, trimmed and not empty."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n"), lambda s: F.trim(s)), lambda s: s != "")


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Pieces of size characters that begin every size - overlap ones; the last may be shorter."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(step)).cast("int"))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
