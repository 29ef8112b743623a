import pytest
from pyspark.sql import functions as F

from corposcope import formatting, metrics
from corposcope.engine import Engine
from corposcope.errors import FileNotIndexed, InvalidPattern, ToolError
from corposcope.functions import regexq as rq
from corposcope.operators import docops, fts, grep, indexing, merkle, ngram_index, outline, refs, security
from corposcope.operators.pending import pending_paths
from corposcope.operators.prefix import ranks, running_sums
from corposcope.operators.segments import Segments
from corposcope.plans import search as plans
from corposcope.sources import corpus as sources

RUST = """use std::fmt;

pub struct Ledger {
    rows: Vec<u32>,
}

impl Ledger {
    pub fn total(&self) -> u32 {
        if self.rows.is_empty() { 0 } else {
            self.rows.iter().sum()
        }
    }
}

mod tests;
enum Kind { A, B }
"""
PY = """class Box:
    def open(self):
        return 1

    async def close(self):
        pass

def main():
    Box().open()
"""
JS = "export function ready(x) {\n  return x;\n}\nclass View {\n}\nconst go = (a) => {\n  return a;\n};\n"
GO = "package x\n\nfunc (b *Box) Open(n int) error {\n\treturn nil\n}\n\ntype Box struct {\n}\n\ntype Door interface {\n}\n"
FILES = [(1, "/w/p/src/ledger.rs", RUST), (2, "/w/p/src/box.py", PY), (3, "/w/p/web/view.js", JS), (4, "/w/p/box.go", GO),
         (5, "/w/p/.env", "Ledger=1\n"), (6, "/w/p/empty.rs", ""), (7, "/w/p/null.rs", None), (8, "/w/p/crlf.txt", "Ledger one\r\nledger two\r\nend")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(FILES, "file_id long, path string, content string").cache()


def test_lines(corpus):
    rows = sources.lines(corpus.where("file_id in (6, 7, 8)")).orderBy("line_no").collect()
    assert [(r["file_id"], r["line_no"], r["line"]) for r in rows] == [(8, 1, "Ledger one"), (8, 2, "ledger two"), (8, 3, "end")]


def test_grep_forms_agree(corpus):
    a = {r["file_id"]: (r["count"], r["max_line"], r["snippets"]) for r in grep.file_stats(grep.matches(corpus, "self")).collect()}
    b = {r["file_id"]: (r["count"], r["max_line"], r["snippets"]) for r in grep.grep(corpus.union(corpus), "self").collect()}
    assert a == b and a[1][0] == 3 and a[2][0] == 2
    with pytest.raises(InvalidPattern):
        grep.matches(corpus, "(a+)+")


def test_prefilter_loses_no_line(spark):
    """Hits equal those of the lines alone, whatever anchors, flags or repetitions the pattern has."""
    texts = ["use a\nfn b\n", "fn b", "x\r\nfn b\r\ny", "a  \nb", "a b", "", "\n\n", "été nu\nпривет мир\n", "a\n\nb", "FN b\nfn", None, "q{\n}"]
    c = spark.createDataFrame([(i, f"/p{i}", t) for i, t in enumerate(texts)], "file_id long, path string, content string")
    for pattern in (r"\Afn", r"fn b\Z", r"\Afn b\z", r"^fn", r"b$", r"(?i)fn", r"(?s)a.*b", r"(?m)^fn", r"a\s*+b", r"a\s+b", r"\w+", r"\bмир\b", r"\p{L}+ м", r"^$", r"(?P<n>fn) b", r"[^a]b", r"\{$"):
        rx = rq.check_pattern(pattern)
        plain = {(r["file_id"], r["line_no"]) for r in sources.lines(c).where(F.col("line").rlike(rx)).collect()}
        assert {(r["file_id"], r["line_no"]) for r in grep.matches(c, pattern).collect()} == plain, pattern
        hits = c.select("file_id", F.explode(grep.hit_array(F.col("content"), pattern)).alias("h")).collect()
        assert {(r["file_id"], r["h"]["line_no"]) for r in hits} == plain, pattern
    assert grep.matches(c, r"\bмир\b").count() == 1 and grep.matches(c, r"\Afn").count() == 4
    for bad in ("(", "(?P=n)", r"\p{Nothing}", "[z-a]"):
        with pytest.raises(InvalidPattern):
            grep.matches(c, bad)


def test_grep_with_context(corpus):
    rows = grep.with_context(corpus, "LEDGER", grep.GrepConfig(case_insensitive=True, before_context=1, after_context=2)).where("file_id = 8").orderBy("line_no").collect()
    assert [(r["line_no"], r["before"], r["after"]) for r in rows] == [(1, [], ["ledger two", "end"]), (2, ["Ledger one"], ["end"])]
    assert grep.with_context(corpus, "self", grep.GrepConfig(max_matches=2)).count() == 2 and grep.with_context(corpus, "zzzz").count() == 0


def test_tokens_of_any_script(spark):
    c = spark.createDataFrame([(1, "a.txt", "Привет, мир"), (2, "b.txt", "die Straße"), (3, "c.txt", "検索 エンジン v2")], "file_id long, path string, content string")
    found = lambda q: {r["file_id"] for r in fts.search(c, q).collect()}
    assert found("мир") == {1} and found("ПРИВЕТ") == {1} and found("straße") == {2} and found("検索") == {3} and found("str") == set() and found("エンジン v2") == {3}


def test_filtered_scan_equals_unfiltered(corpus):
    from corposcope.functions import ngram

    for pattern in ("Ledger", r"Box\(\)", "is_empty|sum", r"pub fn \w+"):
        grams = ngram_index.pattern_ngrams(pattern)
        hits = {r["file_id"] for r in grep.matches(corpus, pattern).collect()}
        if grams:
            found = {r["file_id"] for r in ngram_index.candidates(ngram.index(corpus), grams).collect()}
            assert hits <= found
            assert found == {r["file_id"] for r in corpus.where(ngram.contains_all(F.col("content"), grams)).collect()}


def test_compact_postings(spark):
    idx = spark.createDataFrame([(1, 5), (1, 40000), (2, 5)], "ngram long, file_id long")
    assert sorted((r["ngram"], r["files"]) for r in ngram_index.compact(idx).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_full_text(corpus):
    assert {r["file_id"] for r in fts.search(corpus, "ledger").collect()} == {1, 5, 8}
    assert {r["file_id"] for r in fts.search(corpus, "filename:ledger").collect()} == {1}
    assert {r["file_id"] for r in fts.phrase(corpus, '"ledger two"').collect()} == {8}
    assert fts.search(corpus, "---").count() == 0 and fts.search(corpus.limit(0), "ledger").count() == 0
    assert all(0 <= r["fts_score"] <= 1 for r in fts.search(corpus, "self").collect())


def test_search_modes(corpus):
    top = plans.search(corpus, "Ledger", 10).collect()
    assert {r["file_id"] for r in top} == {1, 8}  # .env is not shown
    assert all(0 <= r["score"] <= 1 for r in top) and "t" in top[0]["sources"]
    assert [r["sources"] for r in plans.search(corpus, "Ledger", 10, "fts").collect()][0] == "f"
    assert plans.search(corpus, "Ledger", 1, "grep").count() == 1
    same = lambda q: {(r["file_id"], r["sources"].replace("t", "")) for r in plans.search(corpus, q, 50, use_ngram=False).collect()}
    for q in ("Ledger", "self rows", r"fn \w+", "zzzz"):
        assert same(q) == {(r["file_id"], r["sources"].replace("t", "")) for r in plans.search(corpus, q, 50).collect()}
    assert plans.search(corpus, "(a+)+", 5).count() == 0  # unsafe: no grep hits, and regular expressions have no full text
    with pytest.raises(InvalidPattern):
        plans.search(corpus, "(a+)+", 5, "grep")
    with pytest.raises(ToolError):
        plans.search(corpus, "x", 5, "other")
    assert plans.clamped(0) == 50 and plans.clamped(900) == 200


@pytest.fixture(scope="module")
def store(spark, corpus, tmp_path_factory):
    made = indexing.IndexStore(spark, f"file://{tmp_path_factory.mktemp('index')}/i")
    made.write(security.visible(corpus).withColumn("hash", F.xxhash64("content")), given_ids=True)
    return made


def test_indexed_search_equals_scan(corpus, store):
    for q in ("Ledger", "self rows", r"fn \w+", "zzzz", "ledger two", r"Box\(\)", "is", "sum"):
        scan = [(r["file_id"], r["score"], r["sources"]) for r in plans.search(corpus, q, 50).collect()]
        assert [(r["file_id"], r["score"], r["sources"]) for r in plans.search_index(store, q, 50).collect()] == scan, q
    assert [r["file_id"] for r in plans.search_index(store, "Ledger", 10, "grep").collect()] == [r["file_id"] for r in plans.search(corpus, "Ledger", 10, "grep").collect()]
    assert plans.search_index(store, "(a+)+", 5).count() == 0
    with pytest.raises(InvalidPattern):
        plans.search_index(store, "(a+)+", 5, "grep")
    with pytest.raises(ToolError):
        plans.search_index(store, "x", 5, "other")


def test_batch_equals_single(spark, corpus, store):
    queries = ["ledger", "self rows", "box", "a.*b", "", "open"]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, query_text string")
    got = plans.batch_search(store, q).collect()
    for i, text in enumerate(queries):
        mine = {r["file_id"]: r["fts_score"] for r in got if r["query_id"] == i}
        if text in ("a.*b", ""):
            assert mine == {}
        else:
            one = {r["file_id"]: r["score"] for r in plans.search_index(store, text, 50, "fts").collect()}
            assert mine == pytest.approx(one)


@pytest.mark.parametrize("most", [100_000, 1])  # words and queries that a task may hold: all, or the forms for more
def test_batch_without_an_index(spark, tmp_path, monkeypatch, most):
    """A batch on a table leaves no index behind and gives the same as SQL and as a stored index."""
    import random

    import duckdb

    import __spark_entry__ as driver

    rng, vocabulary = random.Random(5), ["ledger", "ledgers", "open", "opening", "box", "fn", "naïve", "Straße", "x", "map_key", "mapped"]
    files = [(i, f"/w/{rng.choice(vocabulary)}/{i % 7}.rs", " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for i in range(120)]
    files += files[:9] + [(3, "/w/a.rs", "box"), (200, "/w/.env", "box ledger"), (201, "/w/n.rs", None), (None, "/w/q.rs", "box")]
    asked = ["ledger", "ledger open", "open ledger", "OPEN box", "fn", "box_map", "map_key x", "naive", "a.*b", "", None, "absent", "box absent", "AND", "x fn box", "mapp", "ledger"]
    spark.createDataFrame(files, "file_id long, path string, content string").repartition(3).write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string").write.parquet(f"{tmp_path}/searches.parquet")
    sql = duckdb.connect()
    for t in ("files", "searches"):
        sql.execute(f"create view {t} as from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(sql.execute(driver.oracle_sql()["batch_search"]).fetchall())
    monkeypatch.setattr(plans, "MANY", most)
    found = lambda: sorted(tuple(r) for r in driver.queries()["batch_search"](spark, f"file://{tmp_path}").collect())
    assert found() == want and len(want) > 100
    assert not plans.table_index(spark, f"file://{tmp_path}", build=False).usable()
    plans.table_index(spark, f"file://{tmp_path}")
    assert found() == want
    nothing = plans.batch_scan(sources.files(spark, f"file://{tmp_path}"), spark.createDataFrame([(1, "a.*b")], "query_id long, query_text string"))
    assert nothing.collect() == []


def test_best_files_in_blocks_against_brute_force(monkeypatch):
    """Bounds kept between blocks, pieces and merges lose nothing, ties at the last rank included."""
    import numpy as np
    import pyarrow as pa

    from corposcope.operators import batch

    monkeypatch.setattr(batch, "FIRST", 3)
    monkeypatch.setattr(batch, "BLOCK", 64)
    monkeypatch.setattr(batch, "PIECE", 50)
    rng = np.random.default_rng(8)
    names, n, k, average = rng.choice(10**9, 14, replace=False), 700, 5, 30.0
    files = rng.permutation(n) * 3
    held = [{int(w): float(rng.integers(1, 4)) for j, w in enumerate(names) if rng.random() < (j + 1) / 15} for _ in files]
    length = [int(x) for x in rng.integers(29, 32, n)]
    df = {int(w): sum(int(w) in h for h in held) for w in names}
    sets = [[int(w) for w in rng.choice(names, m, replace=False)] for m in rng.integers(1, 5, 60)]
    asked = batch.Asked.of(pa.table({"q": pa.array(range(100, 160), pa.int64()), "ws": sets, "dfs": [[df[w] for w in s] for s in sets]}), n, average)
    table = pa.table({"file_id": pa.array(files, pa.int64()), "length": pa.array(length, pa.int32()), "ws": [list(h) for h in held], "fs": [list(h.values()) for h in held]})
    got = {}
    for b in batch.best_files(iter(table.to_batches(max_chunksize=150)), asked, k):
        for r in b.to_pylist():
            got.setdefault(r["q"], []).append((-r["fts_score"], r["file_id"]))
    for q, s in enumerate(sets, 100):
        rows = []
        for i, h in enumerate(held):
            if all(w in h for w in s):
                gains = (max(np.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * h[w] * 2.2 / (h[w] + 1.2 * (0.25 + 0.75 * length[i] / average)) for w in s)
                rows.append((-round(min(sum(gains) / 15, 1), 6), int(files[i])))
        assert got.get(q, []) == sorted(rows)[:k], s


def test_outline(corpus):
    rows = {(r["file_id"], r["kind"], r["name"], r["line_no"], r["end_line"], r["level"]) for r in outline.outline(corpus).collect()}
    assert {(1, "struct", "Ledger", 3, 5, 0), (1, "impl", "Ledger", 7, 13, 0), (1, "fn", "total", 8, 12, 1), (1, "mod", "tests", 15, 16, 0),
            (1, "enum", "Kind", 16, 16, 0), (2, "class", "Box", 1, 6, 0), (2, "fn", "open", 2, 3, 1), (2, "fn", "close", 5, 6, 1),
            (2, "fn", "main", 8, 9, 0), (3, "fn", "ready", 1, 3, 0), (3, "class", "View", 4, 5, 0), (3, "fn", "go", 6, 8, 0),
            (4, "fn", "Open", 3, 5, 0), (4, "struct", "Box", 7, 8, 0), (4, "iface", "Door", 10, 11, 0)} == rows


def test_brace_ends_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(25):
        body = "\n".join(rng.choice(["fn a() {", "}", "x { y }", "} else {", "fn b() { }", "z", "mod q;", "{ {", "} }"]) for _ in range(30))
        rows.append((i, f"/f{i}.rs", body))
    c = spark.createDataFrame(rows, "file_id long, path string, content string")
    got = {(r["file_id"], r["line_no"]): r["end_line"] for r in outline.brace_ends(c).collect()}
    for i, _, body in rows:
        ls = body.split("\n")
        for n, line in enumerate(ls, 1):
            if line.startswith(("fn ", "mod ")):
                assert got.get((i, n)) == _closes(ls, n)


def _closes(ls, n):
    depth, seen = 0, False
    for k in range(n, len(ls) + 1):
        for ch in ls[k - 1] + "\n":
            depth += (ch == "{") - (ch == "}")
            seen = seen or ch == "{"
            if ch in "}\n" and seen and depth == 0:
                return k


def test_indent_ends():
    raw = b"def a():\n    x\n\n    def b():\n        y\n\t\n# c\nclass D:\n  z\n\n"
    assert outline.indent_end(raw, [1, 4, 8]) == [5, 5, 9] and outline.indent_end(b"def a(): pass", [1]) == [1] and outline.brace_end(b"", [1]) == [None]


def test_references(corpus):
    rows = {(r["path"], r["line_no"]): r["ref_type"] for r in refs.references(corpus, "Ledger").collect()}
    assert rows[("/w/p/src/ledger.rs", 3)] == "usage" and rows[("/w/p/src/ledger.rs", 7)] == "usage"  # `pub struct` is no definition line
    assert refs.references(corpus, "self", per_file=1).count() == 2
    kinds = [r["ref_type"] for r in refs.references(corpus, "Box", per_file=None).orderBy("path", "line_no").collect()]
    assert "definition" in kinds


def test_documents(corpus):
    one = corpus.where("file_id = 8")
    assert docops.get_range(one, 2, 3).first()["content"] == "ledger two\nend"
    assert docops.get_range(one, 9, 10).count() == 0 and docops.get_range(one, 3, 2).count() == 0
    assert docops.context(one, 2, 1).first()["content"] == "    1 | Ledger one\n>   2 | ledger two\n    3 | end"
    assert docops.context(one, 99, 1).first()["content"].startswith("    2 | ledger two")
    entries = docops.tree(corpus, "/w/p", 2).collect()
    listing = formatting.tree(entries, 2, 5)
    assert listing.split("\n")[:4] == ["src/", "  box.py", "  ledger.rs", "web/"]
    t = docops.tree_totals(docops.tree(corpus, "/w/p", 1)).first()
    assert (t["total_dirs"], t["total_files"]) == (2, 5)


def test_running_sums_over_hot_groups(spark):
    rows = [("hot", i % 97, 1 + i % 3) for i in range(3000)] + [(f"g{i % 50}", i, 1) for i in range(500)] + [(None, 1, None)]
    df = spark.createDataFrame(rows, "g string, x int, v int")
    got = running_sums(df, ["g"], [F.col("x").asc()], {"s": "v"}).collect()
    assert len(got) == len(rows)
    for r in got[::37]:
        assert r["s"] == sum(v or 0 for g, x, v in rows if g == r["g"] and x <= r["x"])
    k = ranks(df.where("g = 'g1'"), ["g"], [F.col("x").desc()]).collect()
    assert sorted(r["rank"] for r in k) == list(range(1, 11))
    assert running_sums(df.limit(0), ["g"], [F.col("x").asc()], {"s": "v"}).count() == 0


def test_staged_tables(spark):
    import os

    from corposcope import session

    df = session.staged(spark.range(5), "t")
    assert df.count() == 5 and df.dtypes == [("id", "bigint")]
    folder = session._stage_dir(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    session.purge(spark)
    assert not os.path.exists(folder)


def test_merkle_changes(spark):
    old = [("r1", f"p{i}", i) for i in range(2000)] + [("r2", "a", None), ("r2", None, 3)]
    new = [("r1", f"p{i}", i + (i == 7)) for i in range(1, 2000)] + [("r1", "new", 5), ("r2", "a", None), ("r2", None, 4)]
    frame = lambda rows: merkle.records(spark.createDataFrame(rows, "root string, path string, hash long"), "root", "path", "hash")
    got = {(r["part"], r["key"], r["status"]) for r in merkle.changed_records(frame(new), frame(old)).collect()}
    assert got == {("r1", "p0", "removed"), ("r1", "p7", "changed"), ("r1", "new", "added"), ("r2", None, "changed")}
    touched = merkle.differing_leaves(merkle.leaves(frame(new)), merkle.leaves(frame(old))).count()
    assert touched <= 4
    assert merkle.changed_records(frame(new), frame(new)).count() == 0
    empty = merkle.records(spark.createDataFrame([], "root string, path string, hash long"), "root", "path", "hash")
    assert merkle.changed_records(empty, frame(old)).count() == len(old)


def test_store_survives_a_crash(spark, tmp_path):
    store = Segments(spark, "file://" + str(tmp_path / "s"))
    assert store.manifest() == {} and store.live("t", ["k"]) is None
    df = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    first = store.add({"t": df(("a", 1), ("b", 2), (None, 3))})
    store.publish({"segments": [first]})
    store.add({"t": df(("a", 9))})  # a run that died before its pointer moved
    rows = lambda: {tuple(r) for r in store.live("t", ["k"]).collect()}
    assert rows() == {("a", 1), ("b", 2), (None, 3)}
    second = store.add({"t": df((None, 4), ("c", 5))}, df((None, 0), ("a", 0)).select("k"))
    store.publish({"segments": [first, second]})
    assert rows() == {("b", 2), (None, 4), ("c", 5)} and len(store.vacuum()) == 1 and rows() == {("b", 2), (None, 4), ("c", 5)}
    store.publish(store.compacted(store.manifest(), ["k"]))
    assert rows() == {("b", 2), (None, 4), ("c", 5)} and len(store.manifest()["segments"]) == 1


def test_incremental_runs(spark, tmp_path, monkeypatch):
    store = Segments(spark, "file://" + str(tmp_path / "inc"))
    frame = lambda rows: merkle.records(spark.createDataFrame(rows, "root string, path string, hash long"), "root", "path", "hash")
    calls = []

    def process(rows):
        calls.append({r["key"] for r in rows.collect()})
        return rows.select("part", "key", (F.col("value") * 10).alias("out"))

    state = lambda: {(r["key"], r["out"]) for r in store.live("output", ["part", "key"]).collect()}
    first = [("r", f"p{i}", i) for i in range(300)]
    merkle.incremental_run(store, frame(first), process)
    assert len(calls[-1]) == 300 and state() == {(f"p{i}", 10 * i) for i in range(300)}
    second = [("r", f"p{i}", i + 1000 * (i == 5)) for i in range(1, 300)] + [("q", None, 7)]

    def broken(rows):
        raise RuntimeError("the run dies")

    with pytest.raises(RuntimeError):
        merkle.incremental_run(store, frame(second), broken)
    assert state() == {(f"p{i}", 10 * i) for i in range(300)}
    merkle.incremental_run(store, frame(second), process)
    assert calls[-1] == {"p5", None}
    assert state() == {(k, 10 * v) for _, k, v in second}
    merkle.incremental_run(store, frame(second), process)
    assert calls[-1] == set() and state() == {(k, 10 * v) for _, k, v in second}
    monkeypatch.setattr(merkle, "MOST_SEGMENTS", 4)
    for i in range(3):  # more runs than segments may stand beside each other
        merkle.incremental_run(store, frame(second + [("q", "grow", i)]), process)
        assert calls[-1] == {"grow"}
    assert state() == {(k, 10 * v) for _, k, v in second} | {("grow", 20)} and len(store.manifest()["segments"]) < 5
    tree = merkle.leaves(frame(second + [("q", "grow", 2)]))
    assert {tuple(r) for r in merkle.latest_tree(store).collect()} == {tuple(r) for r in tree.select("part", "leaf", "digest", "n").collect()}


def _pending(spark, files, scan, diffs, runs):
    f = spark.createDataFrame(files, "path string, hash long, extra string, root string")
    s = spark.createDataFrame(scan, "root string, path string, hash long, seen_at timestamp")
    g = spark.createDataFrame(diffs, "root string, commit_no long, head_oid string, changed array<string>, deleted array<string>")
    r = spark.createDataFrame(runs, "root string, run_no long, outcome string, head_oid string")
    return {(x["path"], x["todo"]) for x in pending_paths(f, s, g, r).collect()}


def test_pending_paths(spark):
    from datetime import datetime as T

    t1, t2 = T(2024, 1, 1), T(2024, 1, 2)
    a, b = "/ws/a", "/ws/b"
    files = [(f"{a}/same", 1, "x", "clash"), (f"{a}/same", 1, "y", "clash"), (f"{a}/old", 1, "", ""), (f"{a}/gone", 1, "", ""), (f"{a}/kept", 1, "", ""),
             (f"{b}/x", 1, "", ""), (f"{b}/unreadable", 1, "", ""), (f"{b}/lost", 1, "", ""), (None, 5, "", "")]
    scan = [(a, f"{a}/same", 1, t1), (a, f"{a}/old", 1, t1), (a, f"{a}/old", 2, t2), (a, f"{a}/old", None, T(2024, 1, 3)), (a, f"{a}/new", 9, t1),
            (a, f"{a}/unmentioned", 9, t1), (b, f"{b}/x", 2, None), (b, f"{b}/unreadable", None, t1), (b, f"{b}/fresh", 3, t1), (a, f"{a}/kept", 1, t1)]
    diffs = [(a, 1, "c1", [f"{a}/unmentioned"], None), (a, 2, "c2", [f"{a}/old", f"{a}/same", None], [f"{a}/kept"]), (a, 3, None, [f"{a}/new"], [f"{a}/gone", f"{a}/never"]),
             (a, 3, None, [f"{a}/new"], []), (a, 4, "c4", [f"{a}/kept"], None)]
    runs = [(a, 1, "ok", "c1"), (a, 1, "ok", "c1"), (a, 2, "failed", "c2"), (b, 1, "ok", "vanished")]
    assert _pending(spark, files, scan, diffs, runs) == {
        (f"{a}/old", "index"), (f"{a}/new", "index"), (f"{a}/gone", "delete"), (f"{b}/x", "index"), (f"{b}/fresh", "index"), (f"{b}/lost", "delete")}
    assert _pending(spark, [], scan[:2], [], []) == {(f"{a}/same", "index"), (f"{a}/old", "index")}
    assert _pending(spark, files[:1], [], [], []) == {(f"{a}/same", "delete")}
    assert _pending(spark, [], [], [], []) == set()


def test_change_lists_and_text(spark):
    rows = spark.createDataFrame([("r", 1, ["a", "b"], None), ("r", 2, None, ["a", None]), ("r", 3, ["c"], ["b"]), ("r", 4, [], ["c"])],
                                 "root string, ordinal long, changed array<string>, deleted array<string>")
    assert {(x["path"], x["status"]) for x in indexing.union_change_lists(rows).collect()} == {("a", "deleted"), ("b", "deleted"), ("c", "deleted")}
    assert indexing.parse_change_text("M\tfile1.rs\nA\tfile2.rs\nD\tfile3.rs\nR100\ta\tb\n\nnonsense") == [
        ("M", "file1.rs"), ("A", "file2.rs"), ("D", "file3.rs"), ("D", "a"), ("A", "b")]


def test_engine_life_cycle(spark, tmp_path):
    root = tmp_path / "home" / "project"
    (root / "src").mkdir(parents=True)
    (root / "src/a.rs").write_text("fn alpha() {\n    beta();\n}\n")
    (root / "src/b.py").write_text("def beta():\n    return 1\n")
    (root / ".env").write_text("KEY=1\n")
    (root / "x.bin").write_bytes(b"\xff\xfe")
    (root / "bad.txt").write_bytes(b"\xff\xfe\x00")
    e = Engine.open(spark, str(root), "file://" + str(tmp_path / "idx"))
    with pytest.raises(ToolError):
        e.corpus()
    assert e.index(commit="c1") == {"processed": 2, "indexed": 2, "unchanged": 0, "deleted": 0}
    assert e.store.metadata() == {"version": indexing.SCHEMA_VERSION, "last_indexed_commit": "c1", "dirty": [], "files": 2, "tokens": e.store.read("lengths").agg(F.sum("length")).first()[0], "last_id": 2, "dead": 0}
    ids = {r["path"]: r["file_id"] for r in e.corpus().collect()}
    (root / "src/a.rs").write_text("fn alpha() {\n    gamma();\n}\n")
    (root / "src/c.go").write_text("package c\n")
    (root / "src/b.py").unlink()
    assert e.index() == {"processed": 2, "indexed": 2, "unchanged": 0, "deleted": 1}
    now = {r["path"]: r["file_id"] for r in e.corpus().collect()}
    assert now[f"{root}/src/a.rs"] == ids[f"{root}/src/a.rs"] and f"{root}/src/b.py" not in now and now[f"{root}/src/c.go"] > max(ids.values())
    fresh = fts.posting_rows(e.corpus()).where("term is not null")
    kept = e.store.read("postings").select(*fresh.columns)
    assert fresh.exceptAll(kept).count() == 0 and kept.exceptAll(fresh).count() == 0
    assert [r["path"] for r in e.search("gamma").collect()] == [f"{root}/src/a.rs"]
    assert {r["file_id"] for r in e.candidates("gamma").collect()} == {now[f"{root}/src/a.rs"]}
    assert e.outline("src/a.rs").first()["end_line"] == 3
    assert e.get("src/a.rs", 1, 1).first()["content"] == "fn alpha() {"
    assert [r["ref_type"] for r in e.refs("alpha").collect()] == ["definition"]
    assert e.diff("src/a.rs", "src/c.go").first()["additions"] == 1
    assert e.stats().first()["total_files"] == 2 and {r["ext"] for r in e.by_type().collect()} == {"rs", "go"}
    assert e.toc().where("is_dir").first()["name"] == "src"
    with pytest.raises(FileNotIndexed):
        e.get("src/zzz.rs")
    assert e.index(force=True)["indexed"] == 2


def test_stream(spark, tmp_path):
    from corposcope.operators.indexing import IndexStore
    from corposcope.streaming import incremental

    src = str(tmp_path / "in")
    schema = "path string, content string, deleted boolean, at timestamp"
    store = IndexStore(spark, "file://" + str(tmp_path / "idx"))

    def feed(rows):
        spark.createDataFrame(rows, "path string, content string, deleted boolean, at string").withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(src)
        incremental.run(spark.readStream.schema(schema).parquet(src), store, str(tmp_path / "cp")).awaitTermination()
        return {r["path"]: r["content"] for r in store.read("files").collect()}

    assert feed([("a.rs", "one", False, "2024-01-01"), ("a.rs", "two", None, "2024-01-02"), ("b.rs", "x", False, None), (None, "n", False, None)]) == {"a.rs": "two", "b.rs": "x"}
    assert feed([("b.rs", None, True, "2024-01-03"), ("c.rs", "y", False, "2024-01-03")]) == {"a.rs": "two", "c.rs": "y"}


def test_metrics_and_formats(spark):
    assert metrics.break_even(4000, [(100, 500), (200, 600)]) == (10, 1) and metrics.break_even(10, []) == (float("inf"),) * 2
    row = metrics.output_metrics(spark.range(1), F.lit(1022), F.lit(4), F.lit(2)).first()
    assert row["tokens"] == 256 and row["density"] == pytest.approx(7.8125) and row["per_kb"] == pytest.approx(4 / 1022 * 1024)
    assert formatting.truncated("abc") == "abc" and formatting.truncated("ab,cd", 4).startswith("ab\n")
    assert formatting.search([{"path": "p", "score": 0.5, "sources": "fg", "snippets": [{"line_no": 3, "line": "x"}]}], True) == "p  (0.50 · fts+grep)\n      3│ x\n(more files match)"
    assert "definition" in formatting.references([{"path": "p", "ref_type": "definition", "line_no": 1, "content": "c"}])
    assert formatting.to_json(spark.createDataFrame([(1, None)], "a int, b string")).first()[0] == '{"a":1}'
