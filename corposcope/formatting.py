"""Plain-text forms of results for a terminal, and JSON. Inputs are the few collected rows of one answer."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame

SOURCES = {"f": "fts", "g": "grep", "t": "trigram"}
MAX_RESPONSE = 512 * 1024


def to_json(df: DataFrame) -> DataFrame:
    """One JSON document per row, null fields left out."""
    from pyspark.sql import functions as F

    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("json"))


def pretty(rows: list[dict]) -> str:
    return json.dumps(rows, indent=2, ensure_ascii=False, default=str)


def truncated(text: str, most: int = MAX_RESPONSE) -> str:
    """At most ``most`` bytes, cut at the last comma or line end, with a notice."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    cut = raw[:most]
    at = max(cut.rfind(b","), cut.rfind(b"\n"))
    return cut[:at if at > 0 else most].decode("utf-8", "ignore") + "\n... [response truncated]"


def search(rows, has_more: bool = False) -> str:
    out = []
    for r in rows:
        out.append(f"{r['path']}  ({r['score']:.2f} · {'+'.join(SOURCES[c] for c in r['sources'])})")
        out += [f"  {s['line_no']:>5}│ {s['line']}" for s in r["snippets"] or []]
    return "\n".join([*out, *["(more files match)"] * has_more])


def no_results(mode: str) -> str:
    """What to try next, by search mode."""
    other = {"grep": "words are found by mode fts, both together by mode combined", "fts": "patterns are found by mode grep, both together by mode combined"}
    return "Nothing found: " + other.get(mode, "use fewer or other words, or see with stats what is indexed") + "."


def references(rows) -> str:
    out, last = [], None
    for r in rows:
        if r["path"] != last:
            out += [""] * (last is not None) + [r["path"]]
            last = r["path"]
        out.append(f"  {r['ref_type']:<12} {r['line_no']:>5}│ {r['content']}")
    return "\n".join(out)


def outline(path: str, file_type: str, rows) -> str:
    end = lambda r: f"-{r['end_line']}" if r["end_line"] else ""
    return "\n".join([f"{path} ({file_type})", *(f"  {'  ' * r['level']}{r['kind']:<6} {r['name']:<20} :{r['line_no']}{end(r)}" for r in rows)])


def tree(rows, total_dirs: int, total_files: int) -> str:
    return "\n".join([*(r["line"] for r in sorted(rows, key=lambda r: r["sort_key"])), f"{total_dirs} directories, {total_files} files"])


def bounded(path: str, content: str) -> str:
    """Content between boundary lines, so that a reader cannot take it for instructions around it."""
    return f"--- BEGIN FILE CONTENT: {path} ---\n{content}\n--- END FILE CONTENT: {path} ---"


def context(path: str, centre: int, content: str) -> str:
    return f"{path}:{centre}\n{content}"


def diff(row) -> str:
    tail = ["[output truncated: the full diff has more hunks]"] * bool(row["truncated"])
    return "\n".join([*row["hunks"], *tail, f"{row['additions']} additions, {row['deletions']} deletions"])


def stats(row, types=()) -> str:
    head = [f"{'Files:':<16} {row['total_files']}", f"{'Trigrams:':<16} {row['ngram_count']}", f"{'Index size:':<16} {row['human']} ({row['bytes']})"]
    kinds = [f"  .{t['ext']:<12} {t['files']}" for t in sorted(types, key=lambda t: (-t["files"], t["ext"]))]
    return "\n".join([*head, *(["", "By file type:", *kinds] if kinds else [])])


def indexed(counters: dict) -> str:
    return (f"Indexed {counters['indexed']} files, {counters['unchanged']} unchanged, {counters['deleted']} deleted "
            f"({counters['processed']} processed)")
