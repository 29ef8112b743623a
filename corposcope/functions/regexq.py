"""Regular expressions and query strings: safety gate, literals, intent, full-text query preparation.

The single-query forms are plain Python for the driver; ``*_column`` forms work on
a table of queries.  Patterns run on Java's engine, which backtracks, so every
pattern must pass ``check_pattern`` first.
"""
from __future__ import annotations

import re
from re import _constants as sre
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PATTERN_BYTES, MAX_NESTING = 500, 5
#: Pattern parts known to backtrack exponentially. Fixed values.
DANGEROUS = (r"(\w+)+", r"(.*)+", r"(.+)+", r"(\d+)+", r"(\s+)+", r"([^x]+)+", r"(\w*)*", r"(.*)*", r"(.+)*", r"(\d*)*", r"(\s*)*",
             r"(a|a)+", r"(a|aa)+", r"(.*|.*)+")
#: A group that repeats inside and is repeated or optional itself. Fixed behaviour.
_NESTED = re.compile(r"\([^)]*[+*][^)]*\)[+*?]")
_REGEX_HINT = r"[\\+?{}|^$\[\]]|\.\*|\.\+"
_BAREWORD = "A-Za-z0-9_"
KEYWORDS = ("AND", "OR", "NOT", "NEAR")
PREFIX_BYTES = 4


def nesting(pattern: str) -> int:
    """Largest depth of groups; escapes and character classes are skipped."""
    plain = re.sub(r"\\.", "", re.sub(r"\[(?:\\.|[^\]\\])*\]", "", pattern, flags=re.S), flags=re.S)
    depth = most = 0
    for c in plain:
        if c == "(":
            depth += 1
            most = max(most, depth)
        elif c == ")":
            depth = max(0, depth - 1)
    return most


def refusal(pattern: str) -> str | None:
    """Why a pattern is unsafe or not of the supported dialect, or None."""
    if len(pattern.encode()) > MAX_PATTERN_BYTES:
        return f"the pattern has more than {MAX_PATTERN_BYTES} bytes"
    if nesting(pattern) > MAX_NESTING:
        return f"groups are nested more than {MAX_NESTING} deep"
    low = pattern.lower()
    if any(d in low for d in DANGEROUS) or _NESTED.search(pattern):
        return "a repeated group repeats inside, which may take exponential time"
    if re.search(r"\(\?(?:[=!]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        return "look-around and back-references are not part of the dialect"
    return None


def java(pattern: str) -> str:
    """The pattern as the executing engine reads it: classes and boundaries over all of Unicode, named groups in its spelling."""
    return "(?U)" + re.sub(r"(?<!\\)((?:\\\\)*)\(\?P<", r"\1(?<", pattern)


def check_pattern(pattern: str) -> str:
    """The pattern for the executing engine if it may run; raises InvalidPattern otherwise.

    It is compiled by that engine, in the driver, so no pattern fails first in a task.
    """
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from corposcope.errors import InvalidPattern

    why = refusal(pattern)
    if why:
        raise InvalidPattern(why)
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("patterns are checked by the JVM of an active session")
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java(pattern))
    except (Py4JError, PySparkException) as e:
        raise InvalidPattern(str(e).strip().splitlines()[0]) from e
    return java(pattern)


def covers_lines(pattern: str) -> bool:
    """Whether a pattern that matches a line also matches, with multi-line anchors, the text that holds the line.

    Anchors of the whole input, flags, and repetitions that never give back may differ between both.
    """
    plain = re.sub(r"\[(?:\\.|[^\]\\])*\]", "x", pattern)
    return not re.search(r"\\[AZzGQ]|\(\?(?!:|P?<[A-Za-z])|[*+?}]\+", plain)


def literals(pattern: str, least: int = 3) -> list[str]:
    """Strings that every match must contain, at least ``least`` bytes each.

    Only what cannot be skipped counts: classes, look-arounds, alternations and
    optional repetitions break a segment; a group's content counts; flags that
    ignore case give none.
    """
    try:
        tree = _parser.parse(pattern)
    except re.error:
        return []
    if tree.state.flags & re.IGNORECASE:
        return []
    out: list[str] = []

    def walk(seq, run: list[str]) -> list[str]:
        for op, arg in seq:
            if op is sre.LITERAL:
                run.append(chr(arg))
            elif op is sre.SUBPATTERN and not (arg[1] or arg[2]):
                run = walk(arg[3], run)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                flush(run)
                run = walk(arg[2], [])
                flush(run)
                run = []
            elif op is sre.AT:
                if arg not in (sre.AT_BOUNDARY, sre.AT_NON_BOUNDARY):
                    flush(run)
                    run = []
            else:
                flush(run)
                run = []
        return run

    def flush(run: list[str]):
        text = "".join(run)
        if len(text.encode()) >= least and text not in out:
            out.append(text)

    flush(walk(tree, []))
    return out


def intent(query: str) -> str:
    """short_token, regex, natural_language or exact_symbol."""
    q = query.strip()
    if not q:
        return "short_token"
    if re.search(_REGEX_HINT, q):
        return "regex"
    if len(q.split()) > 1:
        return "natural_language"
    return "short_token" if len(q.encode()) < PREFIX_BYTES else "exact_symbol"


def intent_column(query: Column) -> Column:
    q = F.trim(query)
    return (F.when(F.coalesce(q, F.lit("")) == "", "short_token")
             .when(q.rlike(_REGEX_HINT), "regex")
             .when(q.rlike(r"\s"), "natural_language")
             .when(F.octet_length(q) < PREFIX_BYTES, "short_token")
             .otherwise("exact_symbol"))


def prepared_words(query: str) -> list[str]:
    """Query words: other ASCII signs separate, operators go, words of four bytes or more match as prefixes."""
    words = re.sub(rf"(?=[\x00-\x7f])[^{_BAREWORD}]", " ", query).split()
    kept = [w for w in words if w not in KEYWORDS]
    return [w + "*" if len(w.encode()) >= PREFIX_BYTES else w for w in kept]


def prepared_column(query: Column) -> Column:
    """``prepared_words`` joined by spaces."""
    words = F.split(F.trim(F.regexp_replace(query, rf"[\x00-\x7F&&[^{_BAREWORD}]]+", " ")), r"\s+")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*KEYWORDS))
    return F.array_join(F.transform(kept, lambda w: F.when(F.octet_length(w) >= PREFIX_BYTES, F.concat(w, F.lit("*"))).otherwise(w)), " ")


FIELDS = ("filename", "path", "content")


def parse_query(query: str) -> tuple[str | None, list[tuple[str, bool]]]:
    """(field or None, [(term, is prefix)]). ``field:words`` limits every word to one field."""
    field, rest = None, query.strip()
    head, colon, tail = rest.partition(":")
    if colon and head in FIELDS:
        field, rest = head, tail
    terms = []
    for w in prepared_words(rest):
        prefix = w.endswith("*")
        parts = re.findall(r"[^\W_]+", w.rstrip("*").lower().translate(str.maketrans(_ACCENTS)))
        terms += [(p, prefix and i == len(parts) - 1) for i, p in enumerate(parts)]
    return field, terms


def _accents() -> dict[str, str]:
    from corposcope.functions.text import ACCENTED, PLAIN

    return dict(zip(ACCENTED, PLAIN))


_ACCENTS = _accents()
