"""Text, path and score expressions. All are built-in expressions and stay in code generation."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with diacritics and their plain forms, as the full-text tokenizer folds them. Fixed values.
ACCENTED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Full-text tokens: runs of letters and digits of any script; an underscore separates."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Score in [low, high]; NaN and null become 0, infinities saturate."""
    return F.least(F.greatest(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(low)), F.lit(high))


def merge_scores(a: Column, b: Column) -> Column:
    """Bounded addition of two scores."""
    return clamp(a + b)


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension; a leading dot alone is no extension; 'unknown' if there is none."""
    found = F.regexp_extract(filename(path), r"^.+\.([^.]+)$", 1)
    return F.when(found == "", "unknown").otherwise(F.lower(found))


def relative(path: Column, root: Column | str) -> Column:
    """Path without the root prefix."""
    root = F.lit(root) if isinstance(root, str) else root
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def trim_around(line: Column, needle: Column | str, most: int = 60) -> Column:
    """Window of ``most`` characters centred on the first occurrence of ``needle``; cut sides get '...'."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    at = F.greatest(F.instr(line, needle) - 1, F.lit(0))
    middle = at + F.floor(F.length(needle) / 2).cast("int")
    begin = F.greatest(F.lit(0), F.least(middle - most // 2, F.length(line) - most))
    cut = F.concat(F.when(begin > 0, "...").otherwise(""), F.substring(line, begin + 1, F.lit(most)),
                   F.when(begin + most < F.length(line), "...").otherwise(""))
    return F.when(F.length(line) <= most, line).otherwise(cut)


def numbered(marker: Column, number: Column, line: Column) -> Column:
    """``{marker}{number:4} | {line}``."""
    return F.format_string("%s%4d | %s", marker, number, line)


def human_bytes(n: Column) -> Column:
    kb, mb = 1024, 1024 * 1024
    return (F.when(n >= kb * mb, F.format_string("%.1f GB", n / F.lit(float(kb * mb))))
             .when(n >= mb, F.format_string("%.1f MB", n / F.lit(float(mb))))
             .when(n >= kb, F.format_string("%.1f KB", n / F.lit(float(kb))))
             .otherwise(F.format_string("%d B", n)))


def token_estimate(n_bytes: Column) -> Column:
    """About four bytes a token."""
    return F.floor((n_bytes + 2) / 4).cast("long")
