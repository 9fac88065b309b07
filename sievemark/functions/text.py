"""Column functions for identities, hashes, whitespace and text similarity; all stay in the JVM."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the code points that Python's str.isspace accepts
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
MASK_31 = 2147483647


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_whitespace(text: Column | str) -> Column:
    """Words joined by one space, as ``" ".join(text.split())``."""
    return F.trim(F.regexp_replace(_col(text), WHITESPACE, " "))


def words(text: Column | str) -> Column:
    # only a blank text has an empty item
    return F.array_remove(F.split(normalize_whitespace(text), " "), "")


def word_count(text: Column | str) -> Column:
    return F.size(words(text))


def sha256_text(text: Column | str) -> Column:
    return F.sha2(_col(text), 256)


def source_id(index: Column | str, prefix: str = "arxiv2k") -> Column:
    return F.format_string(f"{prefix}:%04d", _col(index))


def stable_seed(*parts: Column | str, base_seed: int = 0) -> Column:
    """The first eight bytes of SHA-256 of ``base|part|...``, modulo 2**31 - 1."""
    joined = F.concat_ws("|", F.lit(str(base_seed)), *(_col(p).cast("string") for p in parts))
    return (F.conv(F.substring(F.sha2(joined, 256), 1, 16), 16, 10).cast("decimal(20,0)") % MASK_31).cast("long")


def hash_draw(n: Column | int, *parts: Column | str) -> Column:
    """An integer below ``n`` from the MD5 of the parts: the same in every engine and run."""
    joined = F.concat_ws("|", *(_col(p).cast("string") for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def word_bounds(target: Column | str, lower: float = 0.9, upper: float = 1.1) -> tuple[Column, Column]:
    """ceil(target * lower) and floor(target * upper)."""
    return F.ceil(_col(target) * F.lit(lower)).cast("int"), F.floor(_col(target) * F.lit(upper)).cast("int")


def is_revision(text: Column | str) -> Column:
    """Whether a text is forty lower-case hexadecimal digits and nothing else."""
    return F.coalesce(_col(text).rlike(r"\A[0-9a-f]{40}\z"), F.lit(False))


def git_blob_sha1(content: Column | str) -> Column:
    body = _col(content)
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(body).cast("string")), "utf-8"), F.unhex(F.lit("00")), body))


def canonical_json(*fields: str) -> Column:
    """Canonical JSON of string, integer, boolean, array and struct columns: sorted names, no spaces, nulls kept.

    Floats are written as Spark writes them; keep them out of payloads that are hashed.
    """
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})


def list_hash(ids: Column) -> Column:
    """SHA-256 of the canonical JSON of an array of strings."""
    return F.sha2(F.to_json(ids), 256)


def first_words(text: Column | str, n: int = 12) -> Column:
    return F.slice(words(F.lower(_col(text))), 1, n)


def render(template: str, **values: Column) -> Column:
    """``template`` with ``{name}`` replaced by columns; doubled braces stand for themselves."""
    parts = [x for text, name, _, _ in Formatter().parse(template) for x in (F.lit(text), values[name] if name else F.lit(""))]
    return F.concat(*parts)


def numbered_bundle(number: Column, text: Column, separator: str = "\n\n") -> Column:
    """An aggregate: texts joined in the order of their numbers."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), text.alias("t")))), lambda x: x["t"]), separator)


def edit_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - Levenshtein distance / longer length; two empty texts are alike."""
    longer = F.greatest(F.char_length(_col(a)), F.char_length(_col(b)))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(_col(a), _col(b)) / longer)

