"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a Unicode-aware trim strips.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
FORBIDDEN = '[/\\\\?%*:|"<>]'
CONTAINER_EXT = "(?i)\\.(cst|cct|dcr|dir)$"


def normalize_text(text: Column) -> Column:
    """No NULs, LF line ends, no blanks at the ends."""
    lines = F.replace(F.replace(F.replace(text, F.lit("\x00"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.btrim(lines, F.lit(BLANKS))


def rtf(text: Column) -> Column:
    """An RTF document of the text: backslash and braces escaped, a paragraph mark at each line end."""
    body = text
    for a, b in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", "\\par\n")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return F.concat(F.lit("{\\rtf1\\ansi\\deff0 {\\fonttbl {\\f0 Courier;}}\n"), body, F.lit("\n}"))


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def printable_runs(text: Column, least: int = 3) -> Column:
    """The maximal runs of ``least`` or more ASCII characters from space to tilde, trimmed; blank ones left out."""
    runs = F.regexp_extract_all(text, F.lit(f"[\\x20-\\x7E]{{{least},}}"), F.lit(0))
    return F.filter(F.transform(runs, lambda x: F.trim(x)), lambda x: x != "")


def basename(path: Column) -> Column:
    """The last part of a path with any of the separators ``/ : \\``, without a container's extension."""
    return F.regexp_replace(F.element_at(F.split(F.translate(path, ":\\", "//"), "/"), -1), CONTAINER_EXT, "")


def sanitize(name: Column, fallback: str = "artifact") -> Column:
    """A file name: characters that file systems forbid become ``_``; nothing left gives the fallback."""
    clean = F.trim(F.regexp_replace(name, FORBIDDEN, "_"))
    return F.when(clean.isNull() | (clean == ""), F.lit(fallback)).otherwise(clean)
