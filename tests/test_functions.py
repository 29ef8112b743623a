import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corposcope.errors import AccessDenied, InvalidPattern
from corposcope.functions import ngram, regexq, text
from corposcope.operators import docops, security


@pytest.mark.parametrize("query,kind", [
    ("", "short_token"), ("   ", "short_token"), ("fn", "short_token"), ("abc", "short_token"), ("main", "exact_symbol"),
    ("SearchService", "exact_symbol"), ("auth flow", "natural_language"), (r"fn\s+\w+", "regex"), ("(a|b)", "regex"),
    ("hello.*world", "regex"), ("[A-Z]", "regex"), ("a+b", "regex"), ("x?y", "regex"), ("^start", "regex"), ("end$", "regex")])
def test_intent(query, kind):
    assert regexq.intent(query) == kind


@pytest.mark.parametrize("query,words", [
    ("auth-element", "auth* element*"), ("c++", "c"), ("test{1}", "test* 1"), ("auth AND login", "auth* login*"),
    ("and or", "and or"), ("---", "")])
def test_prepared_words(query, words):
    assert " ".join(regexq.prepared_words(query)) == words


def test_query_columns_equal_the_single_forms(spark):
    queries = ["", "fn", "auth-element", "c++", "x AND yy zzzz", "foo_bar", "a.*b", "größe näher", None]
    rows = spark.createDataFrame([(q,) for q in queries], "q string").select(
        "q", regexq.intent_column(F.col("q")).alias("i"), regexq.prepared_column(F.col("q")).alias("p")).collect()
    for r in rows:
        assert r["i"] == regexq.intent(r["q"] or "")
        if r["q"] is not None:
            assert r["p"] == " ".join(regexq.prepared_words(r["q"]))


@pytest.mark.parametrize("pattern,found", [
    (r"impl\s+Display\s+for", ["impl", "Display", "for"]), ("prefix_(foo|bar)_suffix", ["prefix_", "_suffix"]),
    ("foo.*bar", ["foo", "bar"]), (r"\d+\s+\w+", []), ("(foo)?bar", ["bar"]), ("(?i)foobar", []), ("[abc]def", ["def"]), ("(", [])])
def test_literals(pattern, found):
    assert regexq.literals(pattern) == found


@pytest.mark.parametrize("pattern", ["(a+)+", "(.*)*", "(.+)+", "(" * 6 + "a" + ")" * 6, "a" * 501, r"(a)\1", "(?=a)b"])
def test_unsafe_patterns(pattern):
    assert regexq.refusal(pattern)
    with pytest.raises(InvalidPattern):
        regexq.check_pattern(pattern)


@pytest.mark.parametrize("pattern", [r"fn\s+\w+", "hello.*world", "[a-z]+", r"\(((a))\)[((((((]"])
def test_safe_patterns(pattern):
    assert regexq.refusal(pattern) is None


def _brute_ngrams(raw: bytes) -> set[bytes]:
    w = [int(ngram._WEIGHTS[a, b]) for a, b in zip(raw, raw[1:])]
    out = set()
    for i in range(len(w)):
        for j in range(i + 1, min(len(w), i + 15)):
            inner = max(w[i + 1:j], default=0)
            if w[i] > inner and w[j] > inner:
                out.add(raw[i:j + 2])
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_ngrams_against_brute_force_and_covering(content):
    raw = content.encode()
    every = ngram.ngrams(raw)
    assert every == _brute_ngrams(raw)
    for a in range(len(raw)):
        for b in range(a + 3, min(len(raw), a + 24)):
            assert set(ngram.covering(raw[a:b])) <= every


def test_ngram_examples_and_index(spark):
    assert ngram.covering(b"auth") == [b"aut"] and ngram.covering(b"authenticate") == [b"aut", b"hentica"] and ngram.covering(b"ab") == []
    texts = ["fn authenticate()", "", None, "größe", "fn authenticate() fn authenticate()"]
    rows = ngram.index(spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")).collect()
    for i, t in enumerate(texts):
        got = [r["ngram"] for r in rows if r["file_id"] == i]
        assert sorted(got) == sorted(ngram.key(g) for g in ngram.ngrams((t or "").encode()))


def test_score_edges(spark):
    x = spark.createDataFrame([(1.5,), (-0.5,), (float("nan"),), (math.inf,), (-math.inf,), (None,), (0.25,)], "x double")
    assert [r[0] for r in x.select(text.clamp(F.col("x"))).collect()] == [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.25]
    assert spark.range(1).select(text.merge_scores(F.lit(0.6), F.lit(0.7))).first()[0] == 1.0


def test_text_columns(spark):
    row = spark.range(1).select(
        text.extension(F.lit("/a/b/File.RS")), text.extension(F.lit("/a/.env")), text.extension(F.lit("/a/Makefile")),
        text.human_bytes(F.lit(1536)), text.human_bytes(F.lit(12)), text.numbered(F.lit(">"), F.lit(7), F.lit("x")),
        text.relative(F.lit("/w/a/b.rs"), "/w/a"), text.relative(F.lit("/w/ab.rs"), "/w/a"),
        text.trim_around(F.lit("x" * 50 + "needle" + "y" * 50), "needle")).first()
    assert tuple(row)[:8] == ("rs", "unknown", "unknown", "1.5 KB", "12 B", ">   7 | x", "b.rs", "/w/ab.rs")
    assert row[8].startswith("...") and row[8].endswith("...") and "needle" in row[8] and len(row[8]) == 66


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_lcs_and_hunks(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    pairs = docops.alignment(a, b)
    assert docops.lcs_length(a, b) == len(pairs) == table[-1][-1]
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
    body = [x for h in docops.hunks(a, b) for x in h.split("\n")[1:]]
    assert sum(x[0] == "+" for x in body) == len(b) - len(pairs) and sum(x[0] == "-" for x in body) == len(a) - len(pairs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=20), st.lists(st.sampled_from("abcd"), max_size=20), st.integers(1, 7))
def test_lcs_in_blocks(a, b, columns):
    whole, was = docops.lcs_row(a, b).tolist(), docops.COLUMNS
    docops.COLUMNS = columns
    try:
        assert docops.lcs_row(a, b).tolist() == whole
    finally:
        docops.COLUMNS = was


def test_long_diffs():
    a, b = [f"line {i}" for i in range(30000)], [f"line {i}" for i in range(30000) if i % 100] + ["x"] * 50
    assert len(docops.alignment(a, b)) == 29700


def test_diffs_in_spark(spark):
    rows = spark.createDataFrame([("k", "a\nb\nc\n", "a\nx\nc\n"), ("same", "a\r\n", "a\n"), ("null", None, "x"), ("big", "x\n" * 6000, "y\n" * 6000)],
                                 "key string, old string, new string")
    out = {r["key"]: r for r in docops.diffs(rows).collect()}
    assert (out["k"]["additions"], out["k"]["deletions"], out["k"]["hunks"]) == (1, 1, ["@@ -1,3 +1,3 @@\n a\n-b\n+x\n c"])
    assert out["same"]["hunks"] == [] and out["null"]["additions"] == 1
    assert (out["big"]["additions"], out["big"]["deletions"]) == (6000, 6000)
    cut = docops.diffs(rows.where("key = 'k'"), max_lines=2).first()
    assert cut["truncated"] and cut["additions"] == 1


def test_sensitive_forms_agree(spark):
    names = [n for _, p, _ in security.SENSITIVE for n in (p, "x" + p, p + "x", f"a/{p}", f"a/x{p}", f"a/{p}/b", f"{p}.bak")] + ["a.secret.b/c", "x.rs", "", ".envx", "a/b.env"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert sorted(r[0] for r in security.visible(df).collect()) == sorted(r[0] for r in df.where(security.sensitive_reason(F.col("path")).isNull()).collect())


def test_paths(tmp_path, spark):
    root = str(tmp_path)
    (tmp_path / "src").mkdir()
    assert security.validated(root, "src/../a.rs") == f"{root}/a.rs"
    for bad in ("../x", "/etc/passwd", "a\0b", "src/../../x"):
        with pytest.raises(AccessDenied):
            security.validated(root, bad)
    for bad in (".env", "id_rsa", "x/.aws/credentials", "a.pem", ".env.local"):
        with pytest.raises(AccessDenied):
            security.readable(root, bad)
    for bad in ("/", "/etc", "/usr/bin", "/nowhere/at/all"):
        with pytest.raises(AccessDenied):
            security.workspace_root(bad)
    assert security.workspace_root(f"{root}/src") == f"{root}/src"
    got = spark.createDataFrame([("a/../b",), ("a/../../b",), ("/x",), (None,), ("..",), ("",)], "p string").select(security.path_verdict(F.col("p"))).collect()
    assert [r[0] for r in got] == ["ok", "outside", "absolute", "nul", "outside", "ok"]
