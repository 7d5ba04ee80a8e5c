"""Operators 11 to 13 against brute force, with odd rows of every kind."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from operator import gt, lt

import pytest
from pyspark.sql import functions as F

from grainmill.llm import manifest, periodic_runs, url_filters
from grainmill.llm.queries import URL_RULES, queries
from grainmill.llm.url_filters import Rule
from tests.conftest import DATA
from tests.llm.test_operators import ODD, SCHEMA, SPACE


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 11: periodic runs


def brute_runs(w, least, periods):
    """All maximal runs by comparing the words with themselves at every distance."""
    n, out = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, periods * q):
                part = w[start : start + length]
                if not any(all(part[k] == part[k + r] for k in range(length - r)) for r in range(1, q)):
                    out.append((start, length, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng):
    n = rng.randint(0, 60)
    w = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a, p, m = rng.randrange(n), rng.randint(1, 7), rng.randint(0, 40)
        w = w[:a] + (w[a : a + p] * m)[:m] + w[a + p :]
    return w


def test_lyndon_arrays():
    rng = random.Random(3)
    for _ in range(400):
        w = some_words(rng)
        for less, sign in ((lt, 1), (gt, -1)):
            s = [[sign * ord(c) for c in w[i:]] for i in range(len(w))]
            after, shared = periodic_runs.lyndon_array(w, less)
            for i, j in enumerate(after):
                assert j == next((k for k in range(i + 1, len(w)) if s[k] < s[i]), len(w))
                assert shared[i] == next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)


@pytest.mark.parametrize(("least", "periods"), [(1, 3), (6, 3), (24, 3), (1, 5)])
def test_runs_equal_brute_force(least, periods):
    rng = random.Random(least)
    for _ in range(500):
        w = some_words(rng)
        assert periodic_runs.find_runs(w, least, periods) == brute_runs(w, least, periods), w


def test_runs_take_time_in_proportion():
    """Comparisons of words, counted, on words that match much."""

    class Counted(str):
        seen = 0

        def __eq__(self, other):
            Counted.seen += 1
            return str.__eq__(self, other)

        __hash__ = str.__hash__

    fibonacci, longer = "a", "ab"
    while len(fibonacci) < 20000:
        fibonacci, longer = longer, longer + fibonacci
    for text in ("a" * 20000, "ab" * 10000, fibonacci[:20000], ("a" * 140 + "b") * 140, "a" * 10000 + "b" * 10000):
        for less in (lt, gt):
            Counted.seen = 0
            periodic_runs.lyndon_array([Counted(c) for c in text], less)
            assert Counted.seen <= 4 * len(text)


def plain_digest(doc_id, text):
    words = SPACE.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 24, 3)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_op11_equals_brute_force(spark):
    rows = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 12000]
    out = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in queries()["op11_periodic_runs"](spark, DATA).collect()}
    assert len(out) >= len(rows) > 150 and any(r[1] for r in out.values())
    assert all(out[r["doc_id"]] == plain_digest(r["doc_id"], r["text"]) for r in rows)


def test_op11_odd_rows(spark, odd, none):
    more = odd.unionByName(spark.createDataFrame([(i, f"{'x ' * i}\t{'p q r ' * 9}{'y z ' * 14} end", "en", "s", 1, 7, 7, 7) for i in range(20, 60)], SCHEMA))
    planted = more.withColumn("text", periodic_runs.planted(F.col("doc_id"), F.col("text")))
    got = Counter(tuple(r[c] for c in NAMES) for r in periodic_runs.digest(planted).collect())
    assert got == Counter(plain_digest(r["doc_id"], r["text"]) for r in more.collect())
    assert periodic_runs.digest(none).count() == 0


def test_op11_long_text(spark):
    """Three million words, in one row, of which the last million repeat a thousand."""
    tail = " ".join(f"w{i}" for i in range(1000))
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1_999_999)), lambda x: F.concat(F.lit("u"), x.cast("string"))), " "), F.lit(" "), F.repeat(F.lit(tail + " "), 1000)).alias("text"))
    out = periodic_runs.collapse_runs(docs).select("n_words", "runs", F.length("kept").alias("kept")).first()
    assert out["n_words"] == 3_000_000 and [tuple(r) for r in out["runs"]] == [(2_000_000, 1_000_000, 1000)]
    assert out["kept"] == sum(len(f"u{i}") + 1 for i in range(2_000_000)) + len(tail)


# --- 12: Merkle manifest


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, fanout):
    """The top, and for each leaf the digests left and right of its node on each level."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for leaf, i in enumerate(at):
            first = i // fanout * fanout
            steps[leaf].append(("".join(level[first:i]), "".join(level[i + 1 : first + fanout])))
        level = [sha("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], steps


def plain_manifest(rows, fanout=16):
    """doc_id, leaf, subroot, root, proof, folded, verified of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        low = r[4].translate(str.maketrans(url_filters.UPPER, url_filters.LOWER)) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4]
        groups.setdefault(r[1], []).append((r[0], plain_leaf(r), plain_leaf((*r[:4], low))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = plain_tree([x[1] for x in groups[g]], fanout)
    root, above = plain_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, above, strict=True):
        for (doc_id, leaf, other), steps in zip(groups[g], trees[g][1], strict=True):
            h = other
            for left, right in steps + up:
                h = sha(left + h + right)
            out.append((doc_id, leaf, trees[g][0], root, sha("".join(a + b for a, b in steps + up)), h, h == root))
    return out


def shown(df):
    return Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect())


def test_op12_equals_plain(spark, odd, none):
    more = odd.unionByName(spark.createDataFrame([(i, f"Text {i}", None if i % 3 else "en", f"s{i % 40}" if i % 2 else None, i, 7, 7, 7) for i in range(100, 900)], SCHEMA))
    assert shown(manifest.digest(more)) == Counter(plain_manifest([tuple(r[c] for c in manifest.COLUMNS) for r in more.collect()]))
    assert manifest.digest(none).count() == 0


def test_op12_single_rows(spark):
    one = spark.createDataFrame([(5, "Only Text", "en", "s1", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    r = manifest.digest(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] == plain_leaf((5, "s1", "en", 9, "Only Text")) and r["proof_sha256"] == sha("")


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_of_other_shape(spark, fanout):
    """Other columns, groups and fan-outs; a change of any value of any row is seen, and only there."""
    docs = spark.range(77).select((F.col("id") * 3).alias("doc_id"), (F.col("id") % 5).alias("kind"), F.concat(F.lit("v"), "id").alias("value"), F.lit(1).alias("_g"), F.lit(2).alias("_h"))
    made = manifest.manifest(docs, "kind", ("doc_id", "value"), {"value": F.when(F.col("doc_id") == 30, "other").otherwise(F.col("value"))}, fanout)
    rows = made.rows.select("doc_id", "leaf", "subroot", "root", manifest.folded(F.col("leaf"), F.col("steps")).alias("own"), manifest.folded(F.col("shown_leaf"), F.col("steps")).alias("seen")).collect()
    assert len(rows) == 77 and all(r["own"] == r["root"] for r in rows) and [r["doc_id"] for r in rows if r["seen"] != r["root"]] == [30]
    for g in range(5):
        leaves = [plain_leaf((3 * i, f"v{i}")) for i in range(g, 77, 5)]
        assert {r["subroot"] for r in rows if r["doc_id"] // 3 % 5 == g} == {plain_tree(leaves, fanout)[0]}
    assert {r["group"] for r in made.groups.collect()} == {str(g) for g in range(5)}


# --- 13: URL filters


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = re.split("[?#]", rest[at:], maxsplit=1)[0]
    return rest[:at].translate(str.maketrans(url_filters.UPPER, url_filters.LOWER)), tail


def plain_rule(url, rules):
    host, path = plain_parts(url)
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "allow"), default=None)


PAGES = [
    (1, "http://a.org/1", '<link rel="canonical" href="http://bad.net/es/x">'),
    (2, "http://b.org/2", "<META HTTP-EQUIV='refresh' content='0; URL=http://a.org/1#top'>"),
    (3, "http://www.ok.com/3", '<link href=http://a.org/1 rel=canonical>'),
    (4, "http://c.org/4", '<!-- <link rel="canonical" href="http://bad.net/es/x"> --><p>x</p>'),
    (5, "http://d.org/5", '<script>"<link rel=canonical href=http://bad.net/es/x>"</script>'),
    (6, "HTTP://A.org/1?#z", None),
    (7, "http://A.ORG/1#else", ""),
    (8, "http://e.org/dir/page", '<link rel="canonical" href="other">'),
    (9, "http://e.org/dir/other", '<link rel="canonical" href="//bad.net/fr/1?a=1&amp;b=2">'),
    (10, "http://f.org", '<link rel="canonical" href="/index">'),
    (11, "http://f.org/index", '<meta http-equiv="refresh" content="5"><link rel="stylesheet" href="http://bad.net/es/x">'),
    (12, None, '<link rel="canonical" href="http://bad.net/es/x">'),
    (13, "no scheme/en/", '<link rel="canonical" href="http://bad.net/es/x">'),
    (14, "http://g.org/q?x=1", '<link rel="canonical" href="?x=2">'),
    (15, "http://example.com/en/a", ""),
    (16, "http://www.example.com/en/a", ""),
    (17, "http://notexample.com/en/a", ""),
    (18, "http://example.com", ""),
    (19, "x://://example.com/en/", ""),
    (20, "http://a.org/1", ""),
    (20, "http://a.org/1", ""),
    (None, "http://h.org/", '<link rel="canonical" href="http://h.org/">'),
]


def judged(spark, rows, rules, redirects=None):
    pages = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "page_id long, url string, html string, key int, host string, _rule int")
    logged = None if redirects is None else spark.createDataFrame(redirects, "src string, dst string")
    return url_filters.judge(pages, url_filters.rule_table(spark, rules), logged).collect()


def test_op13_links_carry_blocks(spark):
    out = judged(spark, PAGES, URL_RULES)
    assert Counter(r["page_id"] for r in out) == Counter(p[0] for p in PAGES)
    aliases = {r["page_id"] for r in out if r["alias"]}
    assert aliases == {1, 2, 7, 8, 9, 20}
    by = {r["page_id"]: r for r in out}
    for page_id, url, _ in PAGES:
        fit, r = plain_rule(url, URL_RULES), by[page_id]
        assert (r["host"], r["path"]) == plain_parts(url) and r["rule"] == (fit and fit.host + fit.path)
        assert r["verdict"] == (fit.verdict if fit else "block" if page_id in aliases else "allow")
    assert by[3]["verdict"] == "allow" and by[3]["rule"] == "com/"
    assert judged(spark, [], URL_RULES) == [] and {r["verdict"] for r in judged(spark, PAGES, [])} == {"allow"}


def test_op13_equals_brute_force(spark):
    """Random redirects, among them one target of a third of all pages, against a search from each blocked url."""
    rng = random.Random(5)
    hosts, paths = ["a.org", "x.a.org", "b.net", "c.b.net", "com", "d.com", "localhost"], ["", "/", "/en/", "/en/1", "/es/2", "/fr/3", "/q"]
    urls = [f"http://{rng.choice(hosts)}:{i}{rng.choice(paths)}" if i % 3 else f"http://{rng.choice(hosts)}{rng.choice(paths)}{i}" for i in range(400)]
    rules = [Rule("block", "net", "/es/"), Rule("allow", "b.net", "/es/2"), Rule("block", "a.org", "/en/"), Rule("allow", "a.org", "/en/"), Rule("allow", "x.a.org", ""), Rule("block", "d.com", "/q")]
    links = [(rng.choice(urls), rng.choice(urls)) for _ in range(150)] + [(u, urls[7]) for u in urls[100:230]]
    near = {}
    for a, b in links:
        a, b = (u + "/" if u.count("/") == 2 else u for u in (a, b))
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    todo = [u for u in near if (fit := plain_rule(u, rules)) and fit.verdict == "block"]
    reached = set(todo)
    while todo:
        for v in near[todo.pop()] - reached:
            reached.add(v)
            todo.append(v)
    for r in judged(spark, [(i, u, None) for i, u in enumerate(urls)], rules, links):
        u = urls[r["page_id"]]
        fit = plain_rule(u, rules)
        u = u + "/" if u.count("/") == 2 else u
        assert r["verdict"] == (fit.verdict if fit else "block" if u in reached else "allow"), u
        assert r["rule"] == (fit and fit.host + fit.path)
