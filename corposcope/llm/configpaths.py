"""Configuration text as (key path, value) entries with byte ranges: YAML, JSON, TOML, INI, properties, env and XML.

The readers follow the structure of a format and go on behind what they cannot
read, so templates and broken files give the entries that are whole.  A list item
has its position as the last part of its path; in XML the text of a naming
attribute (``key``, ``name``, ``id``) or of a ``name``/``key`` element before the
value is a part.  Ranges exclude quotes; escapes stay as they are written.

Edge cases: an empty text has no entries; a block scalar is one entry; aliases,
anchors and tags are not values; unclosed brackets are read up to their line.
"""
from __future__ import annotations

import re
from typing import NamedTuple

#: Reader of each file extension. Fixed values.
FORMS = {"yaml": "yaml", "yml": "yaml", "json": "json", "jsonc": "json", "json5": "json", "toml": "toml", "ini": "ini", "cfg": "ini",
         "conf": "ini", "properties": "properties", "env": "env", "xml": "xml", "config": "xml", "plist": "xml", "tf": "ini", "hcl": "ini"}
#: Endings that stand behind the extension of a variant, as in ``app.yaml.example``.
_VARIANT = {"example", "sample", "template", "dist", "local", "production", "development", "staging", "test", "bak", "orig"}


class Entry(NamedTuple):
    path: tuple[bytes, ...]
    begin: int
    end: int
    quoted: bool


def form_of(path: str | None) -> str:
    """Name of the reader for a path, empty if it is not a configuration file."""
    parts = (path or "").rsplit("/", 1)[-1].lower().split(".")
    if parts[0] == "" and len(parts) > 1 and parts[1] == "env":
        return "env"
    while len(parts) > 2 and parts[-1] in _VARIANT:
        parts.pop()
    return FORMS.get(parts[-1], "") if len(parts) > 1 else ""


_DOUBLE = rb'"(?:[^"\\]|\\.)*+"'
_QUOTED = re.compile(rb"(?:" + _DOUBLE + rb"|'(?:[^']|'')*+')", re.S)
_FLOW = {form: re.compile(
    rb"(?P<skip>[\s,;]+|#[^\n]*|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<open>[{\[])|(?P<close>[}\]])|(?P<sep>" + sep + rb")|(?P<quoted>\"{3}.*?\"{3}|'{3}.*?'{3}|"
    + _DOUBLE + rb"|" + single + rb")|(?P<word>(?:" + inner + rb"|[ \t]+(?=" + inner + rb")(?!#))++)", re.S)
    for form, sep, single, inner in (
        ("json", rb":", rb"'(?:[^'\\]|\\.)*+'", rb"[^\s,\[\]{}:\"']"),
        ("yaml", rb":", rb"'(?:[^']|'')*+'", rb"(?:[^\s,\[\]{}:]|:(?![\s,\[\]{}\"']))"),
        ("toml", rb"[=:]", rb"'[^'\n]*+'", rb"[^\s,\[\]{}=\"']"))}
_SEP_NEXT = {"json": re.compile(rb"\s*:"), "yaml": re.compile(rb"\s*:"), "toml": re.compile(rb"\s*[=:]")}


def _bare(text: bytes) -> bytes:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[:1] in b"\"'" and text[:1] == text[-1:] else text


def _dotted(text: bytes) -> tuple[bytes, ...]:
    return tuple(_bare(x) for x in re.findall(rb'"[^"]*"|\'[^\']*\'|[^.]+', text))


def _quotes(raw: bytes, a: int, b: int) -> int:
    return 3 if b - a >= 6 and raw[a:a + 3] in (b'"""', b"'''") else 1


def _flow(raw: bytes, at: int, stop: int, base: tuple, form: str, out: list[Entry]) -> int:
    """Entries of the bracketed value at ``at``, or of all values up to ``stop`` without a base; -1 if it is not closed."""
    token, follows = _FLOW[form], _SEP_NEXT[form]
    frames: list[list] = [[base, False, 0, None]]  # path, list, items so far, key
    while at < stop:
        m = token.match(raw, at, stop)
        if not m:
            at += 1
            continue
        at, kind, top = m.end(), m.lastgroup, frames[-1]
        if kind == "skip":
            n = m.group().count(b",") if m.group()[:1] not in b"#/" else 0
            if n:
                top[2], top[3] = top[2] + 1, None
        elif kind == "open" or kind == "quoted" or kind == "word":
            a, b = m.span()
            if kind != "open" and top[3] is None and (not top[1] or form == "yaml") and follows.match(raw, b, stop):
                name = _bare(m.group())
                top[3] = _dotted(m.group()) if form == "toml" else (_unescaped(name),)
                continue
            path = top[0] + top[3] if top[3] is not None else top[0] + (b"%d" % top[2],) if top[1] else top[0]
            if kind == "open":
                frames.append([path, raw[a] == 91, 0, None])
            else:
                q = _quotes(raw, a, b) if kind == "quoted" else 0
                if path:
                    out.append(Entry(path, a + q, b - q, bool(q)))
                if not top[1]:
                    top[3] = None
        elif kind == "close":
            if len(frames) > 1:
                frames.pop()
                if not frames[-1][1]:
                    frames[-1][3] = None
            if len(frames) == 1 and base:
                return at
    return -1 if base else stop


def _unescaped(name: bytes) -> bytes:
    """A key with its ``\\uXXXX`` escapes read."""
    return re.sub(rb"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)).encode("utf-8", "replace"), name) if b"\\u" in name else name


_MARKS = re.compile(rb"(?:[&!][^\s,\[\]{}]*[ \t]+)*")
_BLOCK = re.compile(rb"[|>][+\-\d]{0,2}[ \t]*(?:#[^\n]*)?\r?(?:\n|\Z)")
_KEY_END = re.compile(rb":(?=[ \t\r\n]|\Z)")
_NOTE = re.compile(rb"(?:^|[ \t])#")


def _yaml(raw: bytes) -> list[Entry]:
    out: list[Entry] = []
    stack: list[tuple[int, bytes]] = []  # level and name; a key has twice its column, an item one more
    at, size, open_end, counts = 0, len(raw), False, {}
    while at < size:
        eol = raw.find(b"\n", at)
        eol = size if eol < 0 else eol
        line, pos = at, at
        at = eol + 1
        while pos < eol and raw[pos] in b" \t":
            pos += 1
        if pos >= eol or raw[pos] in b"#%\r":
            continue
        if raw.startswith((b"---", b"..."), line):
            stack.clear()
            counts.clear()
            continue
        item = False
        while raw[pos:pos + 1] == b"-" and (pos + 1 >= eol or raw[pos + 1] in b" \t\r"):
            level = 2 * (pos - line) + 1
            while stack and stack[-1][0] > level:
                counts.pop(stack.pop()[0], None)
            n = 0
            if stack and stack[-1][0] == level:
                stack.pop()
                n = counts[level] + 1
            counts[level] = n
            stack.append((level, b"%d" % n))
            item, pos = True, pos + 1
            while pos < eol and raw[pos] in b" \t\r":
                pos += 1
        pos = _MARKS.match(raw, pos, eol).end()
        if pos >= eol:
            continue
        col, named = pos - line, False
        q = _QUOTED.match(raw, pos, eol)
        if q:
            colon = re.compile(rb"[ \t]*:").match(raw, q.end(), eol)
            name, after = q.group()[1:-1], colon.end() if colon else -1
        else:
            colon = _KEY_END.search(raw, pos, eol) or (_KEY_END.match(raw, eol - 1) if raw[eol - 1:eol] == b":" else None)
            name, after = (raw[pos:colon.start()].strip(), colon.end()) if colon and raw[pos] not in b"[{|>" else (b"", -1)
            if _NOTE.search(name):
                after = -1
        if after >= 0:
            while stack and stack[-1][0] >= 2 * col:
                counts.pop(stack.pop()[0], None)
            stack.append((2 * col, _unescaped(name)))
            named = True
            pos = after
            while pos < eol and raw[pos] in b" \t":
                pos += 1
            pos = _MARKS.match(raw, pos, eol).end()
        elif not item:  # a scalar on the line below its key
            while stack and stack[-1][0] >= 2 * col:
                counts.pop(stack.pop()[0], None)
        path = tuple(x for _, x in stack)
        if pos >= eol or raw[pos] in b"\r#*" or not path:
            continue
        block = _BLOCK.match(raw, pos)
        if block:
            least = stack[-1][0] // 2
            begin = stop = block.end()
            while stop < size:
                e = raw.find(b"\n", stop)
                e = size if e < 0 else e
                text = raw[stop:e].lstrip(b" \t")
                if text.strip() and e - stop - len(text) <= least:
                    break
                stop = e + 1
            at = stop
            body = raw[begin:stop]
            a = begin + len(body) - len(body.lstrip())
            b = begin + len(body.rstrip())
            if b > a:
                out.append(Entry(path, a, b, False))
            continue
        if raw[pos] in b"[{":
            mark = len(out)
            end = _flow(raw, pos, eol if open_end else size, path, "yaml", out)
            if end < 0:
                open_end = True
                del out[mark:]
            else:
                eol = raw.find(b"\n", end)
                at = size if eol < 0 else eol + 1
            continue
        q = _QUOTED.match(raw, pos) if raw[pos] in b"\"'" else None
        if q:
            out.append(Entry(path, pos + 1, q.end() - 1, True))
            if q.end() > eol:
                eol = raw.find(b"\n", q.end())
                at = size if eol < 0 else eol + 1
            continue
        note = _NOTE.search(raw, pos, eol)
        end = pos + len(raw[pos:note.start() if note else eol].rstrip())
        if end > pos:
            out.append(Entry(path, pos, end, False))
    return out


_SECTION = re.compile(rb"[ \t]*\[+[ \t]*([^\]\r\n]+?)[ \t]*\]+[ \t]*(?:[#;][^\n]*)?\r?$")
_ASSIGN = {form: re.compile(rb"[ \t]*(?:export[ \t]+)?(?P<k>\"[^\"\n]*\"|'[^'\n]*'|" + key + rb")(?P<s>" + sep + rb")[ \t]*") for form, key, sep in (
    ("toml", rb"[^\s=#\[\]{}\"'][^=#\n]*?", rb"[ \t]*="), ("ini", rb"[^\s=:#;{}\[\"'][^\s=:#;{}]*(?:[ \t]+[^\s=:#;{}]+)*?", rb"[ \t]*[=:]|[ \t]+(?![=:{ \t])"),
    ("properties", rb"[^\s=:#!](?:[^\s=:\\]|\\.)*", rb"[ \t]*[=:]|[ \t]+(?![=: \t])"), ("env", rb"[^\s=:#\"'][^\s=:#]*", rb"[ \t]*=|:(?=[ \t])"))}
_LINE_NOTE = {"toml": re.compile(rb"[ \t]*#"), "ini": re.compile(rb"[ \t]+[#;]|[ \t]*;[ \t]*\r?\Z"), "env": re.compile(rb"[ \t]+#")}
_BRACE = re.compile(rb"[ \t]*([^\s={}#;][^={}\n]*?)?[ \t]*[=:]?[ \t]*\{[ \t]*(?:[#;][^\n]*)?\r?$")


def _lines(raw: bytes, form: str) -> list[Entry]:
    """Sections, assignments and, below an assignment, deeper lines: TOML, INI, properties, env and block files."""
    out: list[Entry] = []
    section: tuple = ()
    blocks: list[tuple] = []
    last: tuple = ()
    depth, items, open_end = 0, 0, False
    at, size, assign = 0, len(raw), _ASSIGN[form]
    while at < size:
        eol = raw.find(b"\n", at)
        eol = size if eol < 0 else eol
        line, at = at, eol + 1
        text = raw[line:eol].strip()
        if not text or text[:1] in (b"#", b"!", b";") and not (form in ("env", "toml") and text[:1] == b"!"):
            continue
        indent = eol - line - len(raw[line:eol].lstrip(b" \t"))
        if form in ("toml", "ini"):
            m = _SECTION.match(raw, line, eol)
            if m:
                section, last = _dotted(m.group(1)), ()
                continue
        if form == "ini":
            if text[:1] == b"}":
                blocks = blocks[:-1]
                continue
            if last and indent > depth and not blocks:
                a = line + indent
                out.append(Entry(last + (b"%d" % items,), a, a + len(text), False))
                items += 1
                continue
            m = _BRACE.match(raw, line, eol)
            if m:
                blocks.append(tuple(_bare(x) for x in re.findall(rb'"[^"]*"|\S+', m.group(1) or b"")))
                last = ()
                continue
        m = assign.match(raw, line, eol)
        if not m:
            continue
        name = m.group("k")
        path = section + tuple(x for b in blocks for x in b) + (_dotted(name) if form in ("toml", "properties", "ini") else (_bare(name),))
        last, depth, items, pos = path, indent, 0, m.end()
        if raw[pos:pos + 3] in (b'"""', b"'''"):
            end = raw.find(raw[pos:pos + 3], pos + 3)
            if end >= 0:
                body = raw[pos + 3:end]
                a = pos + 3 + len(body) - len(body.lstrip())
                out.append(Entry(path, a, pos + 3 + max(len(body.rstrip()), a - pos - 3), True))
                eol = raw.find(b"\n", end)
                at = size if eol < 0 else eol + 1
                continue
        if raw[pos:pos + 1] in (b"[", b"{") and form in ("toml", "ini"):
            mark = len(out)
            end = _flow(raw, pos, eol if open_end or form == "ini" else size, path, "toml", out)
            if end >= 0:
                eol = raw.find(b"\n", end)
                at = size if eol < 0 else eol + 1
                continue
            open_end = True
            del out[mark:]
        q = (re.compile(_DOUBLE + rb"|'[^']*+'", re.S).match(raw, pos, size if form == "env" else eol)
             if raw[pos:pos + 1] in (b'"', b"'") and form != "properties" else None)
        if q:
            out.append(Entry(path, pos + 1, q.end() - 1, True))
            if q.end() > eol:
                eol = raw.find(b"\n", q.end())
                at = size if eol < 0 else eol + 1
            continue
        if form == "properties":
            while raw[line:eol].rstrip(b"\r").endswith(b"\\") and eol < size:  # a value goes on below a final backslash
                line, nxt = eol + 1, raw.find(b"\n", eol + 1)
                if not raw[pos:eol].strip(b" \t\r\\"):
                    pos = line
                eol = size if nxt < 0 else nxt
                at = eol + 1
            pos += len(raw[pos:eol]) - len(raw[pos:eol].lstrip())
        note = _LINE_NOTE[form].search(raw, pos, eol) if form != "properties" else None
        end = pos + len(raw[pos:note.start() if note else eol].rstrip())
        if end > pos:
            out.append(Entry(path, pos, end, False))
    return out


_XML = re.compile(rb"<!--.*?(?:-->|\Z)|<\?.*?(?:\?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<![^>]*>|</(?P<end>[\w:.-]+)\s*>"
                  rb"|<(?P<tag>[\w:.-]+)(?P<attrs>(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*+)\s*(?P<lone>/?)>|(?P<text>[^<]+)|<", re.S)
_ATTR = re.compile(rb"([\w:.-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")
_NAMING = (b"key", b"name", b"id")


def _xml(raw: bytes) -> list[Entry]:
    out: list[Entry] = []
    frames: list[list] = [[b"", (), ()]]  # tag, path, label given by a name element
    for m in _XML.finditer(raw):
        if m.group("tag"):
            path = frames[-1][1] + frames[-1][2] + (m.group("tag").rsplit(b":", 1)[-1],)
            attrs = [(a.group(1).rsplit(b":", 1)[-1], a.start(2) + 1 + m.start("attrs"), a.end(2) - 1 + m.start("attrs")) for a in _ATTR.finditer(m.group("attrs"))]
            for name in _NAMING:
                label = [raw[a:b] for k, a, b in attrs if k.lower() == name]
                if label and (name != b"id" or not m.group("lone")):
                    path += _dotted(label[0])
                    break
            out += [Entry(path + (k,), a, b, True) for k, a, b in attrs if k.lower() not in _NAMING and b > a]
            if not m.group("lone"):
                frames.append([m.group("tag"), path, ()])
        elif m.group("end"):
            for i in range(len(frames) - 1, 0, -1):
                if frames[i][0] == m.group("end"):
                    del frames[i:]
                    break
        else:
            part = "cdata" if m.group("cdata") else "text"
            body = (m.group(part) or b"")
            if body.strip() and len(frames) > 1:
                a = m.start(part) + len(body) - len(body.lstrip())
                tag = frames[-1][0].rsplit(b":", 1)[-1].lower()
                if tag in (b"key", b"name") and len(frames) > 2:
                    frames[-2][2] = _dotted(body.strip())
                else:
                    out.append(Entry(frames[-1][1], a, a + len(body.strip()), part == "cdata"))
    return out


def entries(raw: bytes, form: str) -> list[Entry]:
    """All scalar values of a configuration text, in order of their position."""
    if form == "json":
        out: list[Entry] = []
        _flow(raw, 0, len(raw), (), "json", out)
    elif form == "yaml":
        out = _yaml(raw)
    elif form == "xml":
        out = _xml(raw)
    else:
        out = _lines(raw, form) if form else []
    return sorted(out, key=lambda e: e.begin)
