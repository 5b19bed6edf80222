"""Text functions. All are built-in expressions except the sequence ratio, which no expression gives."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Arabic block: its presence makes a text right-to-left.
ARABIC = r"؀-ۿ"


def normalize(text) -> Column:
    """Unicode white space collapsed, trimmed, lower case with sharp s folded; null as empty."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    return F.replace(F.lower(F.trim(flat)), F.lit("ß"), F.lit("ss"))


def key(text) -> Column:
    """Lower case, only a-z, 0-9 and Arabic letters left."""
    return F.regexp_replace(F.lower(text), f"[^a-z0-9{ARABIC}]+", "")


def strip_edges(text) -> Column:
    """Without non-word characters at either end."""
    return F.regexp_replace(text, rf"(?U)^[^\w{ARABIC}]+|[^\w{ARABIC}]+$", "")


def is_rtl(text) -> Column:
    return F.coalesce(text.rlike(f"[{ARABIC}]"), F.lit(False))


def direction(text) -> Column:
    return F.when(is_rtl(text), "rtl").otherwise("ltr")


def align(text, in_cell=None) -> Column:
    """Right for right-to-left, centre in a grid cell, else left."""
    base = F.when(is_rtl(text), "right").otherwise("left")
    return base if in_cell is None else F.when(in_cell, "center").otherwise(base)


# Width of a character in em by class; a character belongs to the first class that has it.
WIDTHS = (
    (r"\p{M}", 0.0),
    (r"\s", 0.32),
    (ARABIC, 0.42),
    (r"\u2e80-\u9fff\uac00-\ud7af", 1.0),
    (r"\p{Nd}\u00b2\u00b3\u00b9\u2070-\u2079\u2080-\u2089", 0.56),
    (r"\p{IsUppercase}", 0.67),
    (r"\p{IsLowercase}", 0.52),
    (r"\p{P}", 0.34),
)
OTHER_WIDTH = 0.7
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def width_units(text) -> Column:
    """Sum of character widths in em: each class, less the classes before it, is counted in the text on its own."""
    text = F.coalesce(text, F.lit(""))
    total, earlier = F.length(text) * F.lit(OTHER_WIDTH), ""
    for chars, width in WIDTHS:
        own = f"[{chars}]" if not earlier else f"[[{chars}]&&[^{earlier}]]"
        rest = F.regexp_replace(text, f"(?U){own}+", "")
        total = total + (F.length(text) - F.length(rest)) * F.lit(width - OTHER_WIDTH)
        earlier += chars
    return total


def max_line_units(text) -> Column:
    """The widest line, at least half an em."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.greatest(F.lit(0.5), F.coalesce(F.array_max(F.transform(lines, width_units)), F.lit(0.5)))


def font_size(ink_height, page_height_mm, box_w_mm, box_h_mm, text, dense=False) -> Column:
    """Points: measured from the ink, clamped to 6-72, then capped by the height and width of the box."""
    measured = ink_height * page_height_mm * F.lit(72 / 25.4) * F.when(is_rtl(text), 1.7).otherwise(1.45)
    size = F.greatest(F.lit(6.0), F.least(F.lit(72.0), measured))
    lines = F.size(F.split(F.coalesce(text, F.lit("")), r"\R"))
    tall = F.greatest(F.lit(6.0), box_h_mm * F.lit(72 / 25.4 * 0.92) / lines)
    wide = F.greatest(F.lit(6.0), box_w_mm * F.lit(72 / 25.4 * 0.86) / (max_line_units(text) * F.lit(2.2 if dense else 1.0)))
    return F.least(size, tall, wide)


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of the standard library's difflib; null as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def redact(text, most: int = 240) -> Column:
    """URLs and long tokens replaced, blanks collapsed, cut to ``most`` characters."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)https?://\S+", "[url]")
    out = F.regexp_replace(out, r"[A-Za-z0-9_-]{32,}", "[redacted]")
    return F.left(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(most))


def redact_secret(text, most: int = 500) -> Column:
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\b(access_token|refresh_token|code|client_secret)=[^\s&]+", "$1=[REDACTED]")
    return F.left(out, F.lit(most))


def filename(text, default: str = "document", suffix: str = ".docx") -> Column:
    """Runs of disallowed characters as one dash, no dash at the ends, the default for nothing, and the suffix."""
    base = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    base = F.when(base == "", default).otherwise(base)
    return F.when(F.endswith(base, F.lit(suffix)), base).otherwise(F.concat(base, F.lit(suffix)))


def xml_escape(text) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sha256(content) -> Column:
    """Lower-case hexadecimal digest of bytes or of a text in UTF-8."""
    return F.sha2(content, 256)


def hex_to_rgb(color) -> Column:
    part = lambda i: F.conv(F.substring(color, i, 2), 16, 10).cast("int")
    return F.when(color.rlike("^#[0-9a-fA-F]{6}$"), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def rgb_to_hex(r, g, b) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in (r, g, b)]))
