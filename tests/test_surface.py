import random
import subprocess

import pytest
from pyspark.sql import functions as F

from corposcope import __main__ as cli
from corposcope.engine import Engine
from corposcope.functions.stem import stem
from corposcope.operators import indexing
from corposcope.plans import search as plans
from corposcope.sources import corpus as sources
from corposcope.sources import vcs


@pytest.mark.parametrize("word,root", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"),
    ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"), ("sensibiliti", "sensibl"), ("formalize", "formal"),
    ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adjustable", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"),
    ("controll", "control"), ("roll", "roll"), ("is", "is"), ("x2", "x2")])
def test_stem(word, root):
    assert stem(word) == root


def test_stemmed_search(spark, tmp_path):
    c = spark.createDataFrame([(1, "a.txt", "running tests"), (2, "b.txt", "he runs a test"), (3, "c.txt", "other text"), (4, "d.txt", None), (5, "e.txt", "поиск tests")],
                              "file_id long, path string, content string")
    store = indexing.IndexStore(spark, f"file://{tmp_path}/i")
    store.write(c.withColumn("hash", F.xxhash64("content")), given_ids=True)
    found = lambda q, **k: {r["file_id"] for r in plans.search_index(store, q, **k).collect()}
    assert found("run testing") == {1, 2} and found("tested") == {1, 2, 5} and found("zzz") == set() and found("поиск") == {5} and found("filename:b test", mode="fts") == set()
    assert [r["has_more"] for r in plans.search_index(store, "test", 2).collect()] == [True, True] and not plans.search_index(store, "test", 3).first()["has_more"]


def test_index_grows_by_segments(spark, tmp_path, monkeypatch):
    """A run of 1 % changes writes little, searches equal those of an index built anew, and a run that dies leaves the state."""
    import os

    rng = random.Random(4)
    words = [f"w{i}x" for i in range(300)]
    text = lambda: " ".join(rng.choice(words) for _ in range(200))
    state = {f"/r/f{i:03}.txt": text() for i in range(300)}
    frame = lambda rows: spark.createDataFrame(rows, "path string, content string").withColumn("hash", F.xxhash64("content")).coalesce(2)
    store = indexing.IndexStore(spark, f"file://{tmp_path}/grow")
    size = lambda: sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(tmp_path / "grow") for f in names if f.endswith(".parquet"))
    assert store.write(frame(list(state.items())), "c1")["indexed"] == 300
    whole = size()
    state |= {"/r/f001.txt": "w1x fresh words", "/r/new.txt": text()}
    del state["/r/f002.txt"]
    kept = store.manifest()
    for step in ("files", "postings", "publish"):  # the run dies before each thing that it writes
        with monkeypatch.context() as m:
            if step == "publish":
                m.setattr(store, "publish", lambda made: (_ for _ in ()).throw(RuntimeError("dies")))
            else:
                add = indexing.IndexStore.add
                m.setattr(store, "add", lambda tables, *a, **k: (_ for _ in ()).throw(RuntimeError("dies")) if step in tables else add(store, tables, *a, **k))
            with pytest.raises(RuntimeError):
                store.write(frame(list(state.items())), "c2")
        assert store.manifest() == kept and store.read("files").count() == 300
    store.vacuum()
    before = size()
    assert store.write(frame(list(state.items())), "c2") == {"processed": 300, "indexed": 2, "unchanged": 298, "deleted": 1}
    assert size() - before < 0.05 * whole and len(store.manifest()["segments"]) == 2
    assert store.update(frame([("/r/f003.txt", "w2x only")]), spark.createDataFrame([("/r/f004.txt",), ("/r/never.txt",)], "path string"))["deleted"] == 1
    state |= {"/r/f003.txt": "w2x only"}
    del state["/r/f004.txt"]
    anew = indexing.IndexStore(spark, f"file://{tmp_path}/anew")
    anew.write(frame(list(state.items())))
    for one in (store, anew):
        m = one.metadata()
        assert (m["files"], m["tokens"]) == (299, one.read("lengths").agg(F.sum("length")).first()[0])
    for q in ("w1x", "w2x w7x", "fresh words", "w1."):
        got = [[(r["path"], r["score"], r["sources"]) for r in plans.search_index(s, q, 10).collect()] for s in (store, anew)]
        assert got[0] == got[1] and got[0]
    store.publish(store.compacted(store.manifest(), ["file_id"]))
    assert [(r["path"], r["score"]) for r in plans.search_index(store, "w1x", 10).collect()] == [(r["path"], r["score"]) for r in plans.search_index(anew, "w1x", 10).collect()]
    assert len(store.vacuum()) >= 3 and store.read("files").count() == 299


def test_search_reads_candidates_only(spark, tmp_path):
    rows = [(i, f"/r/f{i}.txt", f"alpha{i} beta" if i % 10 else f"needle{i} thread") for i in range(2000)]
    store = indexing.IndexStore(spark, f"file://{tmp_path}/c")
    store.write(spark.createDataFrame(rows, "file_id long, path string, content string").withColumn("hash", F.xxhash64("content")), given_ids=True)
    hits, found, n = plans._lines_found(store, store.manifest(), "needle12[0-9]0")
    assert n == 200 and hits.count() == 10 and found.count() == 200
    text = plans._some_files(store, store.manifest(), found.limit(3), 3)
    assert "In(file_id" in text._jdf.queryExecution().executedPlan().toString() and text.count() == 3


def _git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_version_control(tmp_path, spark):
    _git(tmp_path, "init", "-q")
    for n in "abc":
        (tmp_path / f"{n}.rs").write_text(f"fn {n}() {{}}\n")
    (tmp_path / ".gitignore").write_text("skip_me/\n*.log\n")
    _git(tmp_path, "add", "-A")
    _git(tmp_path, "commit", "-qm", "one")
    first = vcs.head(str(tmp_path))
    (tmp_path / "a.rs").write_text("fn a2() {}\n")
    _git(tmp_path, "commit", "-qam", "two")
    (tmp_path / "b.rs").unlink()
    (tmp_path / "new.rs").write_text("fn n() {}\n")
    (tmp_path / "skip_me").mkdir()
    (tmp_path / "skip_me/x.rs").write_text("fn x() {}\n")
    got = {(s, p) for _, s, p in vcs.changes(str(tmp_path), first)}
    assert got == {("M", "a.rs"), ("D", "b.rs"), ("A", "new.rs")}
    assert vcs.is_ancestor(str(tmp_path), first) and not vcs.is_ancestor(str(tmp_path), "0" * 40)
    seen = {r["path"].rsplit("/", 1)[1] for r in sources.walk(spark, str(tmp_path), ignored=vcs.ignored(str(tmp_path))).collect()}
    assert seen == {"a.rs", "c.rs", "new.rs"}
    rows = spark.createDataFrame([(str(tmp_path), i, [p] if s != "D" else None, [p] if s == "D" else None) for i, s, p in vcs.changes(str(tmp_path), first)],
                                 "root string, ordinal int, changed array<string>, deleted array<string>")
    assert {(r["path"], r["status"]) for r in indexing.union_change_lists(rows).collect()} == {("a.rs", "changed"), ("b.rs", "deleted"), ("new.rs", "changed")}


def test_engine_below_version_control(tmp_path, spark):
    """Runs read what changed since the indexed commit, and what was uncommitted then; ignored files stay out."""
    root = tmp_path / "home" / "w"
    root.mkdir(parents=True)
    _git(root, "init", "-q")
    (root / ".gitignore").write_text("skip_me/\n")
    (root / "a.rs").write_text("fn a() {}\n")
    (root / "b.rs").write_text("fn b() {}\n")
    (root / "skip_me").mkdir()
    (root / "skip_me/x.rs").write_text("fn x() {}\n")
    _git(root, "add", "-A")
    _git(root, "commit", "-qm", "one")
    (root / "new [1].rs").write_text("fn n() {}\n")  # untracked
    (root / "b.rs").write_text("fn b2() {}\n")  # uncommitted
    e = Engine(spark, f"file://{tmp_path}/i", str(root))
    names = lambda: {r["path"].rsplit("/", 1)[1]: r["content"] for r in e.corpus().collect()}
    assert e.index()["indexed"] == 3 and set(names()) == {"a.rs", "b.rs", "new [1].rs"} and e.store.metadata()["dirty"] == ["b.rs", "new [1].rs"]
    _git(root, "checkout", "-q", "b.rs")  # back to what is committed: no list of changes names it
    (root / "a.rs").write_text("fn a3() {}\n")
    _git(root, "commit", "-qam", "two")
    (root / "new [1].rs").unlink()
    assert e.index() == {"processed": 2, "indexed": 2, "unchanged": 0, "deleted": 1}
    assert names() == {"a.rs": "fn a3() {}\n", "b.rs": "fn b() {}\n"}
    assert e.index() == {"processed": 0, "indexed": 0, "unchanged": 0, "deleted": 0} and e.index(force=True)["indexed"] == 2
    assert [r["path"] for r in e.ids(["a.rs", "zz.rs"]).collect()] == [f"{root}/a.rs"]
    assert e.paths([r["file_id"] for r in e.ids(["a.rs"]).collect()]).first()["path"] == f"{root}/a.rs"


def test_command_line(tmp_path, spark):
    root = tmp_path / "w"
    (root / "src").mkdir(parents=True)
    (root / "src/a.rs").write_text("fn alpha() {\n    beta();\n}\n")
    (root / "src/b.rs").write_text("fn beta() {}\n")
    engine = Engine(spark, "file://" + str(tmp_path / "i"), str(root))
    said = lambda *args: cli.run(engine, cli.parser().parse_args(args))
    assert said("index")[0].startswith("Indexed 2 files")
    text, code = said("search", "beta")
    assert code == 0 and "src/a.rs" in text and "│" in text
    assert said("search", "zzzz")[1] == 1 and said("refs", "zzzz")[1] == 1
    assert "definition" in said("refs", "beta")[0] and "alpha" in said("outline", "src/a.rs")[0]
    assert said("get", "src/a.rs", "--end", "1", "--bounded")[0] == "--- BEGIN FILE CONTENT: src/a.rs ---\nfn alpha() {\n--- END FILE CONTENT: src/a.rs ---"
    assert said("get", "src/a.rs", "--end", "1")[0] == "fn alpha() {" and "> " in said("context", "src/a.rs", "2", "-C", "1")[0].replace(">   2", "> ")
    assert said("toc")[0].split("\n") == ["src/", "  a.rs", "  b.rs", "1 directories, 2 files"]
    assert "1 additions, 3 deletions" in said("diff", "src/a.rs", "src/b.rs")[0]
    assert ".rs" in said("stats", "--detailed")[0] and said("--json", "stats")[0].startswith("[")
    assert cli.default_index(str(root)) != cli.default_index(str(tmp_path)) and cli.default_index(str(root), "hdfs:///x/").startswith("hdfs:///x/corposcope/")
    other = tmp_path / "w2"
    other.mkdir()
    (other / "z.py").write_text("def z(): pass\n")
    there = ["--index", f"file://{tmp_path}/i2", "workspace", str(other)]
    assert said(*there)[0].endswith("run index next")
    Engine(spark, f"file://{tmp_path}/i2", str(other)).index()
    assert ": 1 files in" in said(*there)[0]
    assert engine.store.read("files").where("size > 0 and indexed_at is not null").count() == 2
