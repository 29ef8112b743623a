"""Credentials written out in source and configuration, with byte offsets, and their redaction.

Each file is searched once as bytes for

* values of sensitive keys: a key whose last words name a credential, an assignment
  of any of the usual forms (``k = v``, ``k: v``, ``put("k", v)``, ``with_k(v)``,
  ``["k"] = v``, ``k => v``), and a literal value of credential shape;
* values whose own shape tells: issued tokens with fixed prefixes, signed web
  tokens, passwords inside URLs and connection strings, Basic and Bearer headers,
  login commands, private key blocks with a body;
* passwords mentioned in comments about logins or rotation.

Placeholders, empty values, look-ups, declarations, public keys, certificates,
checksums and ids are not credentials.  Configuration formats are parsed into key
paths with byte ranges (``configpaths``) and the key test is applied to every part of
a path, so a value below a sensitive parent counts too; a part that describes the
credential (its name, file, user, age) does not.  Patterns run over these files as
well, for comments and embedded text.  A finding has the byte range of
the value only, and redaction splices a fixed word into the original bytes there,
so quotes, line ends, indentation and all other bytes stay as they were.

Edge cases: null or empty content has no findings; bytes that are not UTF-8 pass
through unchanged; repeated rows of one id give their findings once; a null path
reads as code; an empty table gives an empty result.
"""
from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corposcope.llm import configpaths
from corposcope.session import spread

#: Last words of key names that hold credentials. Fixed values.
_STEM = (rb"passw(?:or)?d|passphrase|passwort|pwd|pass|pw|secret|token|credentials?|"
         rb"api[_-]?key|access[_-]?key(?:[_-]?id)?|secret[_-]?key|private[_-]?key|session[_-]?key|encryption[_-]?key|aes[_-]?key|"
         rb"hmac[_-]?key|signing[_-]?key|auth[_-]?key|master[_-]?key|account[_-]?key|shared[_-]?key|client[_-]?key|"
         rb"service[_-]?key|deploy[_-]?key|license[_-]?key|webhook[_-]?key|storage[_-]?key|cipher[_-]?key|jwt[_-]?key")
_SEP = (rb"""(?:["'`\]]{0,3}\)?[ \t]*(?::[ \t]*[&']*(?:static[ \t]+)?(?:str|String|string)\b[ \t]*=(?!=)|=>|:=|\?=|==?(?![=~])|:(?![:=])|,|\()"""
        rb"""|\[\][ \t]*=|[ \t]+(?=["'`]))[ \t]*""")
_OPEN = rb"""(?:\(|Some\(|String::from\(|[brfu@]{1,2}(?=["']))?[ \t]*(?:[|>][+-]?[ \t]*(?=\r?\n))?(?:\r?\n[ \t]+)?"""
_KEYED = re.compile(
    rb"(" + _STEM + rb")" + _SEP + _OPEN +
    rb"""(?:(?P<q>\"{3}|'{3}|["'`])(?P<v>[^\r\n]*?)(?<!\\)(?P=q)|(?P<u>[^\s"'`,;()\[\]{}<>]+))""", re.I)
_ISSUED = re.compile(
    rb"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{18,}"
    rb"|(?:sk|rk)_live_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{40,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{30,}"
    rb"|SG\.[\w-]{16,}\.[\w-]{16,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{40,}|shp(?:at|ss|ca|pa)_[a-fA-F0-9]{30,}|sk-[A-Za-z0-9-]{32,}"
    rb"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,})")
_URL = re.compile(rb"(?<![\w])[a-z][a-z0-9+.-]{1,20}://[^\s:/@\"'`<>]*:(?P<v>[^\s/@\"'`<>]+)@[\w\[]", re.I)
_CONN = re.compile(rb";[ \t]*(?:pwd|password)[ \t]*=[ \t]*(?P<v>[^;\"'`\s]+)", re.I)
_NETRC = re.compile(rb"\bmachine[ \t]+\S+\s+(?:login[ \t]+\S+\s+)?(?:account[ \t]+\S+\s+)?password[ \t]+(?P<v>[^\s\"'`]+)")
_AUTH = re.compile(rb"\b(?P<k>Basic|Bearer)[ \t]+(?P<v>[A-Za-z0-9+/_~.-]{8,}=*)")
_FLAG = re.compile(rb"(?:(?<![\w-])--?(?:password|passwd|pass|token|secret|api-key|auth)(?:=|[ \t]+)|"
                   rb"\blogin\b[^\r\n\"'`]*?[ \t]-p[ \t]*|\bsshpass[ \t]+-p[ \t]*|\bmysql\b[^\r\n]*?[ \t]-p)(?P<v>[^\s\"'`]+)", re.I)
_PEM = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
                  rb"(?:\\n|\\r|[\s\"'`+,\\()*#;.]|//|--)*(?P<v>[A-Za-z0-9+/=]{24,}"
                  rb"(?:(?:\\n|\\r|[\s\"'`+,\\()*#;.]|//)+[A-Za-z0-9+/=]{16,})*)")
_TALK_WORD, _TALK_TAIL = (
    rb"(?:\blogin\b|\bcredentials?\b|\brotate\b|\bold (?:one|password|token|key)\b|\bpass(?:word|phrase|wd)?\b|\bpw\b|\bcreds\b)",
    rb"(?:[:=/]|\bis\b|\bwas\b)[ \t]+[\"'`]?(?P<v>[^\s\"'`,;()<>]{6,})[\"'`]?[ \t]*[.)]?(?:\*/)?[ \t]*\r?$")
_TALK = re.compile(_TALK_WORD + rb"[^\r\n]*?" + _TALK_TAIL, re.I | re.M)
_WORD, _TAIL = re.compile(_TALK_WORD, re.I), re.compile(_TALK_TAIL, re.I | re.M)
_PLACEHOLDER = re.compile(
    rb"^(?:[x*.\-_#0]+|<.*>|\[.*\]|\$.*|%[({].*|%[sdv]|@.*@|\{.*\}|#\{.*|.*\$\{.*|.*\{\{.*|"
    rb"(?:an?|my|the|your|some|any|new|old|test|fake|mock|dummy|sample|example|placeholder|insert|replace|change|redacted|hidden|todo|tbd|fixme|none|null|nil|"
    rb"undefined|empty|unset|true|false|default|secret|password|passwd|token|key|value|string|env|vault|enter)"
    rb"(?:[-_. ]?(?:me|here|this|it|token|password|passwd|secret|key|value|api|auth|access|client|your|my|the|goes|in|with|real|a|be|set|foo|1|123))*|"
    rb"(?:your|example|dummy|fake|sample|insert|placeholder)[-_. ][a-z._ -]*(?:0|1|12|123|1234|x+)?|.*[-_. ](?:here|example|placeholder)|.*EXAMPLE.*|(?:env|vault|secret|ssm|file|kms|arn|op)[:/].*|"
    rb"(?:process\.env|os\.environ|os\.getenv|getenv|System\.getenv|env::var|std::env).*)$", re.I | re.S)
_CONFIG = {"env", "yaml", "yml", "toml", "ini", "cfg", "conf", "properties", "local", "production", "example", "template",
           "sample", "sh", "bash", "zsh", "json", "dockerfile", "tf", "hcl", "xml", "development", "staging", "test"}
_COMMENT_LINE = re.compile(rb"[ \t]*(?://|#(?!define|include|if|endif)|/?\*|--[ \t]|;|<!--|%)")
DDL = "file_id long, line_no long, kind string, key_path string, begin long, finish long"
WORD = b"REDACTED"


def _strong(v: bytes) -> bool:
    """Shape of a made-up password or a random string, not of a name or a number."""
    letter, digit = re.search(rb"[A-Za-z]", v), re.search(rb"\d", v)
    symbol = re.search(rb"[^\w\s./:-]", v)
    if not letter or len(v) < 6:
        return False
    if digit:
        return True
    if symbol and re.search(rb"[A-Z]", v) and re.search(rb"[a-z]", v) and not re.search(rb"[()<>{}\[\]]", v):
        return True
    return len(v) >= 16 and not re.search(rb"[_\-\s./]", v) and len(re.findall(rb"[a-z][A-Z]", v)) >= 3


def _irregular(v: bytes) -> bool:
    """Letters only, but with capitals inside lower case more often than names have them."""
    parts = re.findall(rb"[A-Z]+[a-z]*|[a-z]+", v)
    return len(v) >= 8 and v.isalpha() and len(parts) >= 3 and len(v) <= 4 * len(parts) and bool(re.search(rb"[a-z]", v))


def _plain_id(v: bytes) -> bool:
    """Numbers, versions, paths, dotted or snake-case names: values that only name something."""
    return bool(re.fullmatch(rb"[\d.,_+-]+|0x[0-9a-fA-F]{1,8}|[a-z]+\d?(?:[_.:-][a-z]+\d?)+|(?:[A-Z][A-Z0-9]*_)+[A-Z0-9]+|/?(?:[\w.-]+/)+[\w.-]*|"
                             rb"[a-z]\w*(?:(?:\.|::|->)\w+)+|[a-z_]{1,}\d{1,2}", v))


def _key_start(raw: bytes, at: int) -> int:
    while at > 0 and (raw[at - 1:at].isalnum() or raw[at - 1] in b"_-."):
        at -= 1
    return at


def _ends_word(raw: bytes, key_at: int, at: int, stem: bytes) -> bool:
    """Whether the stem stands as a word at the end of the key (``admin_pass``, ``dbPassword``, not ``compass``)."""
    if at == key_at or raw[at - 1] in b"_-.":
        return True
    return stem[:1].isupper() and not (raw[at - 1:at].isupper()) or stem.lower() not in (b"pass", b"pw", b"pwd", b"token", b"secret", b"credential")


#: Literals that every match of a pattern begins with or holds; they are found far faster than alternatives of a pattern.
_ISSUED_AT = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"github_pat_", b"glpat-", b"sk_live_", b"rk_live_", b"npm_", b"pypi-", b"xox", b"AIza", b"SG.", b"hf_",
              b"dop_v1_", b"shpat_", b"shpss_", b"shpca_", b"shppa_", b"sk-", b"eyJ")
_KEY_AT = (b"pass", b"pw", b"secret", b"token", b"credential")
_BEFORE_KEY = re.compile(rb"(?:api|access|secret|private|session|encryption|aes|hmac|signing|auth|master|account|shared|client|service|deploy|license|webhook|storage|cipher|jwt)[_-]?\Z")
_TALK_AT = (b"login", b"credential", b"rotate", b"old ", b"pass", b"pw", b"creds")
_FLAG_AT = re.compile(rb"-(?:pass|token|secret|api-key|auth)|[ \t]-p")


def _spots(text: bytes, literals: tuple[bytes, ...]) -> list[int]:
    """Sorted positions of all literals."""
    out = []
    for x in literals:
        at = text.find(x)
        while at >= 0:
            out.append(at)
            at = text.find(x, at + 1)
    return sorted(out)


def _key_spots(low: bytes) -> list[int]:
    """Where the words of sensitive key names begin."""
    out = set(_spots(low, _KEY_AT))
    for at in _spots(low, (b"key",)):
        m = _BEFORE_KEY.search(low, max(0, at - 12), at)
        if m:
            out.add(m.start())
    return sorted(out)


#: Parts below a sensitive part that only hold its value, and those that describe it. Fixed values.
_NEUTRAL = re.compile(rb"\d+|value|val|text|string|data|content|raw|plain(?:text)?|literal|current|previous|default|key|live|prod(?:uction)?|primary|secondary", re.I)
_DESCRIBES = re.compile(
    rb"(?:.*[_.-]|.*(?-i:(?<=[a-z])(?=[A-Z])))?(?:names?|refs?|path|file(?:name)?|dir(?:ectory)?|ids?|type|kind|alg(?:orithm)?|issuer?|audience|expir\w*|ttl|age|lifetime|timeout|"
    rb"interval|length|size|min|max|count|limit|ur[il]|endpoint|host(?:name)?|port|user(?:name)?|login|email|account|owner|desc(?:ription)?|comment|note|title|label|labels|"
    rb"help|hint|message|format|pattern|regex|charset|policy|scopes?|roles?|version|provider|store|backend|manager|source|from|env|variable|var|enabled|required|"
    rb"created\w*|updated\w*|rotat\w*|at|date|time|header|prefix|suffix|field|column|param|hash|checksum|digest|fingerprint|sha\d*|md5|e?tag|rev(?:ision)?|commit|uuid|guid|region|zone|bucket|namespace|"
    rb"image|command|script|module|class|public\w*|mount\w*|metadata|annotations)", re.I)
_SENSITIVE = re.compile(rb"(" + _STEM + rb")s?$", re.I)


def _stem_of(name: bytes) -> bytes | None:
    """The credential word a key part ends with."""
    m = _SENSITIVE.search(name)
    if not m or re.search(rb"public", name, re.I) or not _ends_word(name, _key_start(name, m.start(1)), m.start(1), m.group(1)):
        return None
    return m.group(1)


def _of_path(raw: bytes, e: configpaths.Entry) -> bool:
    """Whether the value of an entry is a credential by its whole key path."""
    v = raw[e.begin:e.end]
    if len(v) < 6 or re.search(rb"\s", v) or _PLACEHOLDER.match(v):
        return False
    for i in range(len(e.path) - 1, -1, -1):
        stem = _stem_of(e.path[i])
        if not stem and i and e.path[i].lower() in (b"key", b"keys", b"keyid", b"key_id"):
            stem = _stem_of(e.path[i - 1] + b"_" + e.path[i])
        if stem:
            near = all(_NEUTRAL.fullmatch(x) for x in e.path[i + 1:])
            if not near and b"://" in v:  # the password in it is found by its own rule
                return False
            if _plain_id(v) and not (near and e.quoted and re.search(rb"pass|pwd", stem, re.I)):
                return False
            return _strong(v) or near and e.quoted and _irregular(v)
        if _DESCRIBES.fullmatch(e.path[i]):
            return False
    return False


class LineStarts:
    """Positions of the lines of a text, read once, when one is asked for."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, None

    def number(self, at: int) -> int:
        """Line of a byte position, from 1."""
        if self.at is None:
            self.at = [0, *(m.end() for m in re.finditer(rb"\n", self.raw))]
        return bisect_right(self.at, at)

    def of(self, at: int) -> int:
        """Start of the line of a byte position."""
        n = self.number(at)
        return self.at[n - 1]


def config_entries(raw: bytes, path: str | None) -> list[configpaths.Entry]:
    """Entries of a configuration file; none of other files."""
    form = configpaths.form_of(path)
    return configpaths.entries(raw, form) if form else []


def _talk(raw: bytes, begin: int, end: int) -> tuple[int, int, int] | None:
    """Key position, begin and end of the value where ``_TALK`` matches a line, in time linear in its length.

    What follows the first key word holds what follows any later one, so only that word is tried.
    """
    word = _WORD.search(raw, max(begin, raw.rfind(b"\r", begin, max(begin, end - 2)) + 1), end)
    m = word and _TAIL.search(raw, word.end(), end)
    return (word.start(), *m.span("v")) if m else None


def findings(raw: bytes, config: bool, entries: Sequence[configpaths.Entry] = ()) -> list[tuple[int, int, str, int]]:
    """(begin, end, kind, key position) of every credential value, in order, without overlaps.

    ``entries`` are the parsed values of a configuration file, tested by key path.
    Literal anchors are looked for first; the fuller patterns run only at anchors.
    """
    out: list[tuple[int, int, str, int]] = []
    low = raw.lower()
    begins = LineStarts(raw)
    if b"PRIVATE KEY" in raw:
        for m in _PEM.finditer(raw):
            out.append((m.start(), m.end("v"), "private_key", m.start()))
    for at in _spots(raw, _ISSUED_AT):
        m = _ISSUED.match(raw, at)
        if m and b"EXAMPLE" not in m.group() and not re.search(rb"([A-Za-z0-9*])\1{7}", m.group()):
            out.append((m.start(), m.end(), "issued_token", m.start()))
    at = raw.find(b"://")
    while at >= 0:
        scheme = at
        while scheme > 0 and (raw[scheme - 1:scheme].isalnum() or raw[scheme - 1] in b"+.-"):
            scheme -= 1
        m = next(filter(None, (_URL.match(raw, x) for x in range(max(scheme, at - 21), at))), None)
        if m and not _PLACEHOLDER.match(m.group("v")) and not re.fullmatch(rb"[A-Z_]+|pass\w*|pw|\w?", m.group("v")):
            out.append((m.start("v"), m.end("v"), "url_password", m.start()))
        at = raw.find(b"://", at + 3)
    slot = b"pwd" in low or b"password" in low  # forms in which a place holds a password by their own definition
    for rx, kind, near in ((_CONN, "connection_string", slot), (_NETRC, "netrc", slot and b"machine" in raw), (_FLAG, "command_line", _FLAG_AT.search(low))):
        if near:
            for m in rx.finditer(raw):
                v = m.group("v")
                if (_strong(v) or kind != "command_line" and _irregular(v)) and not _PLACEHOLDER.match(v) and not (kind == "command_line" and _plain_id(v)):
                    out.append((m.start("v"), m.end("v"), kind, m.start()))
    if b"Basic" in raw or b"Bearer" in raw:
        for m in _AUTH.finditer(raw):
            v = m.group("v")
            if m.group("k") == b"Basic":
                try:
                    plain = base64.b64decode(v + b"=" * (-len(v) % 4), validate=True)
                except ValueError:
                    continue
                if b":" in plain and not _PLACEHOLDER.match(plain.split(b":", 1)[1]):
                    out.append((m.start("v"), m.end("v"), "basic_auth", m.start()))
            elif len(v) >= 16 and re.search(rb"\d", v) and not _plain_id(v) and not _PLACEHOLDER.match(v):
                out.append((m.start("v"), m.end("v"), "bearer", m.start()))
    for at in _key_spots(low):
        m = _KEYED.match(raw, at)
        if not m:
            continue
        key_at = _key_start(raw, m.start(1))
        if not _ends_word(raw, key_at, m.start(1), m.group(1)) or re.search(rb"public", raw[key_at:m.end(1)], re.I):
            continue
        quoted = m.group("v") is not None
        v, a = (m.group("v"), m.start("v")) if quoted else (m.group("u"), m.start("u"))
        if _PLACEHOLDER.match(v) or re.search(rb"\s", v) or not (_strong(v) or quoted and _irregular(v)):
            continue
        if not quoted and (_plain_id(v) or not (config or _COMMENT_LINE.match(raw, begins.of(m.start())))):
            continue
        if quoted and _plain_id(v) and not re.search(rb"pass|pwd", m.group(1), re.I):
            continue
        out.append((a, a + len(v), "keyed_value", key_at))
    done = -1
    for at in _spots(low, _TALK_AT):
        if at < done:
            continue
        begin = begins.of(at)
        done = raw.find(b"\n", at) + 1 or len(raw)
        if not _COMMENT_LINE.match(raw, begin, done):
            continue
        m = _talk(raw, begin, done)
        if not m:
            continue
        v = raw[m[1]:m[2]]
        if _strong(v) and not _plain_id(v) and not _PLACEHOLDER.match(v):
            if re.search(rb"[^\w/.:-]", v) or (len(v) >= 12 and re.search(rb"[A-Z]", v) and re.search(rb"[a-z]", v)):
                out.append((m[1], m[2], "comment", m[0]))
    out += [(e.begin, e.end, "keyed_value", e.begin) for e in entries if _of_path(raw, e)]
    out.sort(key=lambda f: (f[0], -f[1], f[2], f[3]))
    kept: list[tuple[int, int, str, int]] = []
    for f in out:
        if not kept or f[0] >= kept[-1][1]:
            kept.append(f)
    return kept


_PIECE = re.compile(rb"""["'`][ \t]*(?:\+|\\|\.|,(?=[ \t]*\r?\n[ \t]*["'`][A-Za-z0-9+/=]+["'`]\)))?[ \t]*\r?\n[ \t]*(?:\+[ \t]*)?["'`](?P<v>[^"'`\r\n]+)(?=["'`])""")


def pieces(raw: bytes, found: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
    """Byte ranges to redact: each value and the string pieces that continue it on the next lines."""
    out = []
    for a, b, kind, _ in found:
        out.append((a, b))
        while kind == "keyed_value" and (m := _PIECE.match(raw, b)):
            out.append((m.start("v"), m.end("v")))
            b = m.end("v")
    return out


def redacted(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """``raw`` with ``WORD`` in place of each range; line ends inside a range are kept."""
    out, at = [], 0
    for a, b in sorted(ranges):
        if a < at:
            continue
        out += [raw[at:a], WORD, b"".join(re.findall(rb"\r?\n", raw[a:b]))]
        at = b
    return b"".join(out) + raw[at:]


_NAME = re.compile(rb"[\w.-]*")


def _extension(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1].lower()
    return "env" if name.startswith(".env") else name.rsplit(".", 1)[-1]


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("file_id", "line_no", "kind", "key_path", "begin", "finish")}
        for fid, path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if not text.is_valid:
                continue
            raw = text.as_buffer().to_pybytes()
            ext = _extension(path)
            entries = config_entries(raw, path)
            begins, lines = [e.begin for e in entries], LineStarts(raw)
            for a, b, kind, key_at in findings(raw, ext in _CONFIG, entries):
                k = bisect_right(begins, a) - 1
                named = (b".".join(entries[k].path).decode("utf-8", "replace") if k >= 0 and a < entries[k].end
                         else _NAME.match(raw, key_at).group().decode("utf-8", "replace"))
                values = (fid, lines.number(a), kind, named, a, b)
                for k, v in zip(out, values):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("file_id", pa.int64()), ("line_no", pa.int64()), ("kind", pa.string()), ("key_path", pa.string()),
            ("begin", pa.int64()), ("finish", pa.int64())]))


def credentials(files: DataFrame) -> DataFrame:
    """(file_id, line_no, kind, key_path, begin, finish): every credential with its byte range in the UTF-8 text."""
    rows = files.where("file_id is not null and content is not null").select(
        F.col("file_id").cast("long").alias("file_id"), "path", "content")
    return spread(rows).mapInArrow(scan, DDL).dropDuplicates(["file_id", "begin", "finish"])


def key_paths(files: DataFrame) -> DataFrame:
    """(path, key_path, value, begin, finish) of every scalar in configuration files; other files give no rows.

    Parts of a key path are joined by slashes, since keys may hold dots.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, b"/".join(e.path).decode("utf-8", "replace"), raw[e.begin:e.end].decode("utf-8", "replace"), e.begin, e.end)
                    for path, text in zip(batch.column(0).to_pylist(), batch.column(1)) if text.is_valid
                    for raw in [text.as_buffer().to_pybytes()] for e in config_entries(raw, path)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + [pa.int64()] * 2)],
                                             ["path", "key_path", "value", "begin", "finish"])

    return files.select("path", "content").mapInArrow(run, "path string, key_path string, value string, begin long, finish long")


def redact(files: DataFrame) -> DataFrame:
    """All columns of ``files``, with the credentials in ``content`` replaced. Rows are never dropped."""
    at, path_at = files.columns.index("content"), files.columns.index("path")
    schema = files.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for path, text in zip(batch.column(path_at).to_pylist(), batch.column(at)):
                if not text.is_valid:
                    texts.append(None)
                    continue
                raw = text.as_buffer().to_pybytes()
                found = findings(raw, _extension(path) in _CONFIG, config_entries(raw, path))
                texts.append((redacted(raw, pieces(raw, found)) if found else raw).decode("utf-8", "surrogateescape"))
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return files.mapInArrow(run, schema)
