"""Files that were not hand-written for their project.

Three kinds of evidence, each for the whole text:

* header rules: a comment line that states a tool wrote the file, or that the
  file comes from another project;
* layout rules: minified text (most characters in very long lines), tables of
  data (most lines are literals), lists that a tool unrolled (most lines share one
  shape of punctuation), and lock files;
* Merkle hashes, bottom-up: a file hashes its lines without white space, line ends
  and leading comments, so re-wrapping and an added header keep the hash; a
  directory hashes the hashes of its children, level by level from the deepest.  A
  directory is a shared subtree if at least ``SHARE`` of its children (and two files)
  have an equal node in one other root, so one edited file does not hide a copied
  library.  All files of a shared subtree are vendored where a place of it is
  confirmed: one copy lies below a directory for other projects' code, or holds a
  header of another project.  The same holds for single files of equal hash.

A file below a third-party directory without any shared copy is judged by its place.
Shared hashes alone prove nothing where such places are known (``places``): projects
also share hand-written files.  Without ``places`` sharing alone marks.

Edge cases: a null path has no directory and is judged by its text; a null or
empty text, and one of fewer than ``LEAST_SHARED`` code lines, has no hash to share;
null or zero ``size_bytes`` is ignored, as layout is read from the text; repeated rows
of one id count once; an empty table gives an empty result.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corposcope.session import spread, staged

#: Directories that hold other projects' code, as whole path parts. Fixed values.
THIRD_PARTY = ("vendor", "third_party", "third-party", "thirdparty", "external", "extern", "node_modules", "deps",
               "Pods", "bower_components", "jspm_packages", "site-packages", "Godeps", "Carthage")
#: Names of files that package managers write. Fixed values.
LOCK_NAMES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock",
              "Pipfile.lock", "composer.lock", "Gemfile.lock", "go.sum", "uv.lock", "mix.lock", "pubspec.lock",
              "flake.lock", "packages.lock.json", "gradle.lockfile")
#: Formats in which a renamed lock file may have its version anywhere.
LOCK_FORMATS = ("json", "yaml", "yml")
LONG_LINE, MINIFIED = 350, 0.7
SHAPE, LEAST_LINES, DATA = 0.55, 8, 0.6
SHARE, LEAST_SHARED = 0.5, 3
#: Extensions whose lines naturally share one shape when written by hand.
CONFIG = {"env", "yaml", "yml", "toml", "ini", "cfg", "conf", "properties", "local", "production", "example",
          "template", "sample", "json", "md", "txt", "rst", "csv", "tsv", "gitignore"}

_COMMENT = re.compile(rb"^[ \t]*(?:///?!?|#+!?|/\*+!?|\*+|--|;+|<!--|%+|'|rem\b|\"\"\"|''')[ \t]*(.*?)[ \t]*(?:\*/|-->|\"\"\"|''')?$",
                      re.I)
# The statement must be what the comment says, so prose that mentions such a header does not match.
_TOOL = re.compile(
    rb"^(?:@generated\b(?!.*\bskip)"
    rb"|<auto-?generated\b"
    rb"|auto-?generated (?:file|code|by|from|on|with|using)\b"
    rb"|(?:this|the)(?: \w+)? (?:file|code|class|module|source|header) (?:was|is|has been) (?:\w+ )?(?:auto(?:matically)?[- ]?)?(?:generated|produced|created|written|emitted) (?:by|from|with|using)\b"
    rb"|(?:code|file|source|class|module)?\s*generated (?:by|from|with|using|automatically)\b"
    rb"|machine[- ](?:written|generated)\b"
    rb"|(?:please )?do not (?:edit|modify|change)(?: this file)?(?: by hand| manually)?\s*(?:[!.:;,-]|$)"
    rb"|(?:auto(?:matically)?|machine)[- ]?(?:generated|produced|written|created) (?:by|from|with|using|on)\b"
    rb"|automatisch (?:erzeugt|generiert|erstellt) (?:durch|von|mit|aus)\b"
    rb"|(?:fichier |code )?g(?:\xc3\xa9|e)n(?:\xc3\xa9|e)r(?:\xc3\xa9|e) (?:automatiquement )?(?:par|depuis|avec|\xc3\xa0 partir)\b"
    rb"|(?:archivo |c(?:\xc3\xb3|o)digo )?generado (?:autom(?:\xc3\xa1|a)ticamente )?(?:por|desde|con|a partir)\b"
    rb"|(?:gerado|generato) \w+ (?:por|da)\b"
    rb"|output of \S+ --?\w+)", re.I)
_TOOL_ANY = re.compile(rb"(?:^|\W)(?:do not edit|do not modify by hand|manual changes will be (?:lost|overwritten)|nicht bearbeiten|ne pas modifier|no (?:editar|modificar))\s*[.!]?$", re.I)
_FOREIGN = re.compile(
    rb"^(?:originally (?:part of|from|written for)\b"
    rb"|imported (?:unmodified |verbatim )?from the\b"
    rb"|(?:copied|vendored|taken|adapted|synced|forked) (?:\w+ )?from (?:the )?\S+ (?:project|distribution|repository|upstream|v?\d)"
    rb"|\(c\) [\d, -]+ .*redistributed under"
    rb"|copyright .*\bsee (?:the )?upstream licen[cs]e"
    rb"|copyright .*\bthe (?!authors of this\b)[\w.-]+ (?:contributors|project|developers)\b)", re.I)
_LOCK = re.compile(rb"""(?:["']lockfileVersion["']|^lockfileVersion)[ \t]*:\s*["']?\d""", re.M)
_DROP = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + b"_ \t\r"
_LITERAL = re.compile(rb"""^[ \t]*(?:(?:(?:0x[0-9a-f]+|-?\d+(?:\.\d+)?(?:e-?\d+)?[fuL]?)[ \t]*[,;]?[ \t]*)+|b?["'][^"'\s]{16,}["'][ \t]*(?:[,+.;]|\\)?)[ \t]*$""", re.I)
SCHEMA = "file_id long, root string, dir string, depth int, h long, node long, third boolean, foreign boolean, own string"


def _text_evidence(name: str, raw: bytes) -> tuple[str | None, bool]:
    """(own evidence of a tool, header of another project)."""
    ext = name.rsplit(".", 1)[-1].lower() if name else ""
    if name in LOCK_NAMES or ext == "lock" or b"lockfileVersion" in raw[:200] or ext in LOCK_FORMATS and b"lockfileVersion" in raw and _LOCK.search(raw):
        return "lock", False
    lines = raw.replace(b"\r", b"\n").split(b"\n")
    full = [x for x in lines if x and not x.isspace()]
    foreign, tool = False, False
    for x in full:
        head = x.lstrip()[:3]
        if not head or head[:1] not in b"/#*-;<%'\"rR":
            continue
        m = _COMMENT.match(x)
        if m:
            said = m.group(1)
            if not tool and (_TOOL.match(said) or _TOOL_ANY.search(said)):
                tool = True
            elif not foreign and _FOREIGN.match(said):
                foreign = True
    if tool:
        return "header", foreign
    if not full:
        return None, foreign
    size = sum(map(len, full))
    wide = [len(x) for x in full if len(x) >= LONG_LINE]
    # Ordinary code around one very long string has more short lines than long ones.
    if sum(wide) >= MINIFIED * size and len(full) - len(wide) <= max(4, len(wide)):
        return "minified", foreign
    if len(full) >= LEAST_LINES and sum(1 for x in full if _LITERAL.match(x)) >= DATA * len(full):
        return "data", foreign
    if ext in CONFIG or name.startswith(".env"):
        return None, foreign
    if len(full) >= LEAST_LINES:
        shape = Counter(x.translate(None, _DROP) for x in full)
        shape.pop(b"", None)
        most = shape.most_common(2)
        # Two shapes: an unrolled list often pairs a getter with a constant.
        if most and sum(n for s, n in most if n >= 0.15 * len(full)) >= SHAPE * len(full) and most[0][0] not in (b"}", b"{", b"});"):
            return "unrolled", foreign
    return None, foreign


def _lines(raw: bytes) -> list[bytes]:
    """Lines without white space, line ends and the leading comments: what copying into another project keeps."""
    lines = [x for x in raw.replace(b"\r", b"\n").translate(None, b" \t\f\v").split(b"\n") if x]
    top = next((i for i, x in enumerate(lines) if not _COMMENT.match(x)), len(lines))
    return lines[top:]


def _scanner(places: tuple[str, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        third = re.compile(r"/(?:" + "|".join(map(re.escape, places)) + ")/") if places else None
        digest = lambda raw: xxhash.xxh3_64_intdigest(raw) - (1 << 63)
        for batch in batches:
            ids, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: dict[str, list] = {k: [] for k in ("file_id", "root", "dir", "depth", "h", "node", "third", "foreign", "own")}
            for fid, path, text in zip(ids, paths, batch.column(2)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                parts = (path or "").split("/")
                root, inner = "/".join(parts[:3]), parts[3:-1]
                own, foreign = _text_evidence(parts[-1], raw)
                lines = _lines(raw)
                values = (fid, root, "/".join(inner), len(inner), digest(raw), digest(b"\n".join(lines)) if len(lines) >= LEAST_SHARED else None,
                          bool(third and third.search("/" + "/".join(parts[3:]))), foreign, own)
                for k, v in zip(out, values):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("file_id", pa.int64()), ("root", pa.string()), ("dir", pa.string()), ("depth", pa.int32()), ("h", pa.int64()), ("node", pa.int64()),
                ("third", pa.bool_()), ("foreign", pa.bool_()), ("own", pa.string())]))
    return scan


def merkle_directories(files: DataFrame) -> DataFrame:
    """(root, dir, depth, node, files) of every directory below the roots, from ``files(root, dir, depth, node)``.

    Built bottom-up: each level hashes the nodes of its children, files and the
    directories of the level below, into their parents.  The combination is a sum of
    child hashes, so it merges map-side and no directory is collected however large it
    is.  A level is written out before the next one reads it: the work is one row for each node.
    """
    deepest = files.agg(F.max("depth")).first()[0] or 0
    # Without a hash a child differs from every other, and so does its parent.
    leaf = files.select("root", "dir", "depth", "node", F.lit(1).cast("long").alias("files"))
    done, below = [], None
    for depth in range(deepest, 0, -1):
        children = leaf.where(F.col("depth") == depth)
        if below is not None:
            up = F.regexp_replace("dir", "/?[^/]*$", "")
            children = children.unionByName(below.select("root", up.alias("dir"), F.lit(depth).alias("depth"), "node", "files"))
        one = F.xxhash64("node", "files").cast("decimal(20,0)")
        total = F.when(F.count(F.lit(1)) == F.count("node"), F.sum(one).cast("string"))
        below = staged(children.groupBy("root", "dir", "depth").agg(total.alias("sum"), F.sum("files").alias("files"))
                               .select("root", "dir", "depth", F.when(F.col("sum").isNotNull(), F.xxhash64("sum", "files")).alias("node"), "files"), "level")
        done.append(below)
    out = done[0] if done else leaf.limit(0)
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def shared_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes`` that have an equal node in another root; of its roots, the first and the last tell whether there is another."""
    by = nodes.where("node is not null").groupBy("node", "files").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2")
    return nodes.join(by.drop("r1", "r2"), ["node", "files"])


def _elsewhere(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` has in ``pairs`` a partner other than their root."""
    ends = pairs.groupBy(key).agg(F.min("partner").alias("r1"), F.max("partner").alias("r2"))
    return rows.join(ends, key).where("r1 != root or r2 != root").drop("r1", "r2")


def shared_subtrees(files: DataFrame, directories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root, dir, kind) of the directories of at least two shared files whose children to at least ``SHARE`` have equal
    nodes in one other root, and (kind, partner): every root that has them, the directories' own ones among them.

    Directories with the same shared children are of one kind, whose children are counted
    once in every root: a library that stands in very many roots is one kind, not a row
    for each two roots.  A root that has ``need`` children of a kind also has one of those
    that remain when the most frequent ones, fewer than ``need``, are left out.  So
    only the rarer children look for roots, and a file that all projects have joins nothing.
    """
    up = F.regexp_replace("dir", "/?[^/]*$", "")
    children = (files.where("depth > 0").select("root", "dir", "node", F.lit(1).cast("long").alias("files"))
                     .unionByName(directories.where("depth > 1").select("root", up.alias("dir"), "node", "files")))
    size = children.groupBy("root", "dir").agg(F.count(F.lit(1)).alias("children"))
    met = staged(shared_nodes(children), "met")
    held = staged(met.select("node", "files", F.col("root").alias("partner")).distinct(), "held")
    often = held.groupBy("node", "files").agg(F.count(F.lit(1)).alias("roots"))
    one = F.xxhash64("node", "files").cast("decimal(20,0)")
    # Two files are two children unless a directory is among them.
    need = F.greatest(F.ceil(SHARE * F.col("children")), F.when(F.col("most") == 1, 2).otherwise(1).cast("long"))
    alike = (met.groupBy("root", "dir").agg(F.count(F.lit(1)).alias("equal"), F.max("files").alias("most"), F.sum(one).cast("string").alias("sum"))
                .join(size, ["root", "dir"]).withColumn("need", need).where("equal >= need"))
    alike = staged(alike.select("root", "dir", F.xxhash64("sum", "equal", "need").alias("kind"), "need"), "alike")
    first = alike.groupBy("kind", "need").agg(F.min(F.struct("root", "dir")).alias("at")).select("kind", "need", "at.root", "at.dir")
    parts = met.join(first, ["root", "dir"]).groupBy("kind", "need", "node", "files").agg(F.count(F.lit(1)).alias("times"))
    parts = staged(parts.join(often, ["node", "files"]), "parts")
    # Children by the number of their roots: a few rows for each kind, however large the directory.
    fewer = Window.partitionBy("kind").orderBy(F.desc("roots"))
    levels = parts.groupBy("kind", "need", "roots").agg(F.sum("times").alias("times")).withColumn("from_here", F.sum("times").over(fewer))
    rare = levels.where("from_here >= need").groupBy("kind").agg(F.max("roots").alias("most"))
    near = parts.join(rare, "kind").where("roots <= most").join(held, ["node", "files"]).select("kind", "partner").distinct()
    counted = (near.join(parts, "kind").join(held, ["node", "files", "partner"], "left_semi").groupBy("kind", "partner", "need")
                   .agg(F.sum("times").alias("equal"), F.sum(F.col("times") * F.col("files")).alias("files")))
    partners = staged(counted.where("equal >= need and files > 1").select("kind", "partner"), "partners")
    return _elsewhere(alike.drop("need"), partners, "kind").select("root", "dir", "kind"), partners


def _confirmed(inside: DataFrame, sure: DataFrame, partners: DataFrame) -> DataFrame:
    """(root, d): subtrees not in ``sure`` that hold a file equal to one in a sure subtree of some partner.

    Subtrees of one kind that hold the same such files are looked up once.
    """
    theirs = staged(inside.join(sure, ["root", "d"], "left_semi").where("node is not null").select(F.col("root").alias("partner"), "node").distinct(), "theirs")
    rest = inside.join(sure, ["root", "d"], "left_anti").join(theirs, "node", "left_semi").select("root", "d", "kind", "node").distinct()
    rest = staged(rest, "rest")
    total = F.sum(F.xxhash64("node").cast("decimal(20,0)")).cast("string")
    same = rest.groupBy("root", "d", "kind").agg(total.alias("sum"), F.count(F.lit(1)).alias("n"))
    same = staged(same.select("root", "d", "kind", F.xxhash64("kind", "sum", "n").alias("bundle")), "same")
    first = same.groupBy("bundle").agg(F.min(F.struct("root", "d")).alias("at")).select("bundle", "at.root", "at.d")
    nodes = rest.join(first, ["root", "d"]).select("bundle", "kind", "node")
    pairs = (partners.join(theirs, "partner", "left_semi").join(nodes, "kind").join(theirs, ["partner", "node"], "left_semi")
                     .select("bundle", "partner").distinct())
    return _elsewhere(same, pairs, "bundle").select("root", "d")


def judged(files: DataFrame, *, places: tuple[str, ...] = THIRD_PARTY) -> DataFrame:
    """(file_id, reason): one row for each file that was not hand-written here.

    ``reason`` is the first that holds of: vendored (shared subtree), copied (shared
    file), what the text tells (header, lock, minified, data, unrolled), third_party (place), foreign (header).
    """
    rows = files.where("file_id is not null").select(F.col("file_id").cast("long").alias("file_id"), "path", "content")
    s = staged(spread(rows).mapInArrow(_scanner(places), SCHEMA).dropDuplicates(["file_id", "h"]), "scan")
    directories = merkle_directories(s)
    trees, partners = shared_subtrees(s, directories)
    # Files of shared subtrees, at any depth below them.
    steps = F.split("dir", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.col("depth")), lambda k: F.array_join(F.slice(steps, 1, k), "/")))
    inside = s.where("depth > 0").select("file_id", "root", "node", "third", "foreign", above.alias("d")).join(trees.withColumnRenamed("dir", "d"), ["root", "d"])
    inside = staged(inside, "inside")
    # A subtree is confirmed by its own places or by those of a subtree in any other root it is shared with that holds an equal file.
    sure = (inside.where("third or foreign") if places else inside).select("root", "d").distinct()
    if places:
        sure = staged(sure, "sure")
        sure = sure.unionByName(_confirmed(inside, sure, partners))
    vendored = inside.join(sure, ["root", "d"], "left_semi").select("file_id")
    single = shared_nodes(s.where("node is not null").select("file_id", "root", "third", "foreign", "own", "node", F.lit(1).alias("files")))
    marks = single.where("third or foreign") if places else single
    marked = marks.groupBy("node").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
    copied = (single.where("own is null and not third and not foreign").join(marked, "node").where("r1 != root or r2 != root").select("file_id"))
    reason = F.coalesce("own", F.when(F.col("third"), "third_party"), F.when(F.col("foreign"), "foreign"))
    told = s.select("file_id", F.lit(2).alias("order"), reason.alias("reason")).where("reason is not null")
    every = (vendored.select("file_id", F.lit(0).alias("order"), F.lit("vendored").alias("reason"))
             .unionByName(copied.select("file_id", F.lit(1).alias("order"), F.lit("copied").alias("reason"))).unionByName(told))
    return every.groupBy("file_id").agg(F.min(F.struct("order", "reason"))["reason"].alias("reason"))
