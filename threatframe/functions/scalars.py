"""Scalar column functions (all JVM-side expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEX_PATTERN = r"^([0-9A-Fa-f]{2})*$"
UUID_PATTERN = (r"^([0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
                r"|[0-9A-Fa-f]{32})$")
# Unicode letters, digits and underscore; `\w` in Java regex is ASCII only.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
WS_EDGES = r"^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(x) -> Column:
    """Remove leading and trailing whitespace (tabs, newlines too)."""
    return F.regexp_replace(_c(x), WS_EDGES, "")


def nonempty(x) -> Column:
    """NULL for empty text: the building block of "first non-empty"."""
    c = _c(x)
    return F.when(c == F.lit(""), F.lit(None)).otherwise(c)


def first_nonempty(*xs) -> Column:
    return F.coalesce(*[nonempty(x) for x in xs])


def is_hex(x) -> Column:
    """Even-length hex text (empty is valid: it decodes to zero bytes)."""
    return _c(x).rlike(HEX_PATTERN)


def hex_to_bytes(x) -> Column:
    """Hex text to bytes, NULL stays NULL; bad or odd-length hex gives NULL.

    ``unhex`` alone pads odd lengths, so the pattern guard comes first; callers
    that must reject bad hex pair this with :func:`is_hex`.
    """
    c = _c(x)
    return F.when(c.isNull(), F.lit(None).cast("binary")).when(is_hex(c), F.unhex(c))


def as_bytes(df, name: str) -> Column:
    """A binary column passes through, a text column is read as hex."""
    if df.schema[name].dataType.typeName() == "binary":
        return F.col(name)
    return hex_to_bytes(F.col(name))


def to_id(x) -> Column:
    """Text id to long; empty/NULL gives 0, non-integer text gives NULL."""
    c = _c(x)
    trimmed = F.trim(c)
    return (F.when(c.isNull() | (trimmed == ""), F.lit(0).cast("long"))
            .otherwise(_try_long(trimmed)))


def _try_long(c: Column) -> Column:
    """Digits that fit the type; NULL for other text and beyond its range."""
    return F.when(c.rlike(INTEGER_PATTERN), c.try_cast("long"))


def id_format_ok(x) -> Column:
    c = _c(x)
    t = F.trim(c)
    return c.isNull() | (t == "") | _try_long(t).isNotNull()


def is_uuid(x) -> Column:
    return _c(x).rlike(UUID_PATTERN)


def canonical_uuid(x) -> Column:
    """Lower-case hyphenated form of a hyphenated or 32-hex UUID."""
    h = F.lower(F.regexp_replace(_c(x), "-", ""))
    return F.when(is_uuid(x), F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
        F.substring(h, 17, 4), F.substring(h, 21, 12)))


def first_of_list(x) -> Column:
    """First element of a comma list, trimmed; text without comma unchanged."""
    c = _c(x)
    return F.when(c.contains(","), F.trim(F.split(c, ",").getItem(0))).otherwise(c)


def split_list(x) -> Column:
    """Comma text to an array of stripped, non-empty items."""
    return F.filter(F.transform(F.split(_c(x), ","), lambda s: strip_ws(s)),
                    lambda s: s != "")


def verdict_label(x, positive: str = "true_positive",
                  negative: str = "false_positive") -> Column:
    """1 / 0 / NULL label from a verdict text, case-insensitive."""
    v = F.lower(_c(x))
    return (F.when(v == positive, F.lit(1)).when(v == negative, F.lit(0))
            .otherwise(F.lit(None).cast("int")))


def parse_ts(x) -> Column:
    """ISO-8601 text to timestamp; `Z`, offsets and fractions accepted,
    text without zone read as UTC; unparsable gives NULL."""
    c = F.regexp_replace(_c(x), "Z$", "+00:00")
    return F.coalesce(
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd")),
    )


def trunc_seconds(x) -> Column:
    return F.date_trunc("second", _c(x))


def format_seconds(x) -> Column:
    """Timestamp to `yyyy-MM-ddTHH:mm:ssZ` text (session time zone UTC)."""
    return F.date_format(_c(x), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_before(as_of: str, n: int) -> Column:
    """`as_of` minus N days, as a timestamp literal expression."""
    return F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(int(n)))


def first_hash(sha256, sha1, md5) -> tuple[Column, Column]:
    """First present hash and its kind (sha256, then sha1, then md5)."""
    s256, s1, m5 = nonempty(sha256), nonempty(sha1), nonempty(md5)
    kind = (F.when(s256.isNotNull(), F.lit("sha256")).when(s1.isNotNull(), F.lit("sha1"))
            .when(m5.isNotNull(), F.lit("md5")))
    return F.coalesce(s256, s1, m5), kind


def int_array(x) -> Column:
    """Array of text to array of int; items that are no integers of that range give NULL."""
    return F.transform(_c(x), lambda s: F.when(F.trim(s).rlike(INTEGER_PATTERN),
                                              F.trim(s).try_cast("int")))


def hash_fraction(seed: int | str, x) -> Column:
    """Stable uniform [0, 1) from md5("seed:x"); the same in SQL engines."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), _c(x).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_fraction_sql(seed: int | str, expr: str) -> str:
    """DuckDB form of :func:`hash_fraction`."""
    return (f"(('0x' || substr(md5('{seed}:' || CAST({expr} AS VARCHAR)), 1, 8))::UBIGINT"
            f" / 4294967296.0)")


def sq_dist(a, b) -> Column:
    """Squared Euclidean distance of two numeric arrays, summed in double."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double"))
                   * (x.cast("double") - y.cast("double"))),
        F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def text_tokens(x, lower: bool = True) -> Column:
    c = F.lower(_c(x)) if lower else _c(x)
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)
