"""Text normalisation and conversion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = [(0xFF21, 26), (0xFF41, 26), (0xFF10, 10)]
_FROM = "".join(chr(a + i) for a, n in _WIDE for i in range(n)) + "\u3000" + "\u200b\u200c\u200d\ufeff"
_TO = "".join(chr(a + i - 0xFEE0) for a, n in _WIDE for i in range(n)) + " "


def preprocess(text: Column) -> Column:
    """Full-width letters, digits and spaces become half-width; zero-width characters go. One pass."""
    return F.when(text.rlike("[\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\u3000\u200b-\u200d\ufeff]"), F.translate(text, _FROM, _TO)).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Script and style go, block ends become line breaks, other tags go, six entities are decoded."""
    out = F.coalesce(html, F.lit(""))
    # The conversion's steps, in order.
    for pattern, with_ in (
        (r"(?is)<script.*?</script>", ""),
        (r"(?is)<style.*?</style>", ""),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(p|div|h[1-6]|li|tr|pre|blockquote)>", "\n"),
        (r"<[^>]+>", ""),
        (r"(?i)&nbsp;", " "),
        (r"(?i)&amp;", "&"),
        (r"(?i)&lt;", "<"),
        (r"(?i)&gt;", ">"),
        (r"(?i)&quot;", '"'),
        (r"(?i)&#39;|&apos;", "'"),
        (r"\n{3,}", "\n\n"),
        (r"^\s+|\s+$", ""),
    ):
        out = F.regexp_replace(out, pattern, with_)
    return out


def repair_placeholders(text: Column) -> Column:
    """Placeholders that white space has broken up are joined again."""
    mark = chr(0xE012)
    parts = F.split(F.regexp_replace(text, r"(\[[^\[\]]*\])", f"{mark}$1{mark}"), mark, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"\s+", "")).otherwise(p)), "")


def leaks(text: Column, value: Column, n: int = 6) -> Column:
    """Whether any ``n`` characters in a row of a value survive in a text."""
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(value) - n + 1)), lambda i: F.substring(value, i, F.lit(n)))
    return F.when(F.length(value) <= n, F.contains(text, value)).otherwise(F.exists(windows, lambda w: F.contains(text, w)))
