"""Page text, URL verdicts and nearest vectors against brute force."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import htmltext, topk, urltree
from lattica.llm.htmllabels import labelled_pages


@pytest.fixture(scope="module")
def model():
    return htmltext.train(labelled_pages())


def test_messages_match_enumeration():
    trees = [htmltext.parse(p) for p in ("<div><p>a</p><ul><li>b<li>c</ul></div><p>d", "x<nav><a>y</a></nav>")]
    f = htmltext.forest(trees)
    rng = np.random.default_rng(2)
    m = htmltext.Model(rng.normal(size=htmltext.N_UNARY), rng.normal(size=(3, 2, 2)))
    n = len(f.parents)
    total = np.zeros(n)
    z = 0.0
    local = np.bincount(f.row, m.unary[f.col], n)
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        w = np.exp(sum(local[i] * y[i] for i in range(n)) + sum(m.pair[f.kind[i], y[p], y[i]] for i, p in enumerate(f.parents) if p >= 0))
        z += w
        total += w * np.array(y)
    assert np.allclose(htmltext.marginals(f, m), total / z)


def test_held_out_labelled_pages(model):
    trees = [htmltext.parse(p) for p in labelled_pages(150, seed=77)]
    y = np.array([int("y1" in n.split()) for t in trees for n in t.names])
    has = np.array([c > 0 for t in trees for c in t.chars])
    assert ((htmltext.marginals(htmltext.forest(trees), model) >= 0.5) == y)[has].mean() > 0.98


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li>'
    '<li><a href="/b">News</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now.</div><article><h1>Head &amp; line</h1><p><b>One  two\n three.'
    "<br><p>A&eacute; &lt;b&gt; x&nbsp;y &am</p><p>Short.</p><p></p></article><div id=comments><h2>Comments</h2><div class=comment><p>I think so.</p></div></div>"
    "<aside><h3>More</h3><ul><li><a href=/c>Else</a></li></ul></aside><form><label>Mail</label><input name=q></form><footer>&copy; example</footer>"
)


def test_extract(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<<<>>> < a"), (1, "u", PAGE), (5, "u", "<article>" + "<p>Word word word.</p>" * 4000 + "<p>open"), (None, None, PAGE[:-400])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = htmltext.extract(pages, model).collect()
    want = "Head & line\n\nOne two three.\n\nAé <b> x y &am\n\nShort."
    assert len(got) == len(rows) and got[0].text == want == got[4].text and got[0].n_chars == len(want)
    assert (got[1].text, got[1].n_chars, got[1].url) == ("", 0, None) and got[2].text == ""
    assert got[5].text.count("Word word word.") == 4000
    assert htmltext.extract(pages.limit(0), model).count() == 0


def plain_verdict(host, path):
    best = None
    for verdict, h, p in urltree.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    return best


def test_urls(spark):
    rng = random.Random(3)
    urls = [None, "", "no-scheme/en/7", "http://", "://x", "HTTP://WWW.Example.COM/en/7?a=b", "https://b.example.com#/en/", "ftp://h/a/b/c/d/e/f/1/2/3", "x://evilexample.com/en/7", "a://com/en/", "é://ÉX.org/es/", "u://a.net/de/\n8", "u://a\nb.example.net/de/8?q#r"]
    for host in ("a.example.com", "b.example.net", "c.org", "deep.x.com"):
        for _ in range(60):
            urls.append(f"https://{host}/{rng.choice(['en', 'de', 'es', 'shop'])}/{rng.randrange(200)}{rng.choice(['', '/', '.html', '?p=1'])}")
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[5]), (None, urls[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("template", F.lit(1)).withColumn("rule", F.lit(1))
    got = urltree.judge(pages).collect()
    assert sorted((r.page_id is None, r.page_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    by = {r.page_id: r for r in got if r.page_id}
    for i, u in rows[1:-2]:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
            path = rest[n:].split("?")[0].split("#")[0]
        r = by[i]
        assert (r.host, r.path) == (host, path)
        rule = plain_verdict(host, path)
        assert r.rule == (rule[0] if rule else None)
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")
    assert urltree.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("html", ["<a " * 350_000, "<a x=\"" * 160_000, "<a \">\" " * 140_000, "<div>" * 100_000 + "</p>" * 100_000, "<li><ul>" + "<blockquote>" * 40_000 + "<li></li>" * 50_000, "<!--" * 250_000, "<script>" * 120_000, "<" * 1_000_000, "<td><tr>" * 60_000])
def test_hostile_markup_takes_linear_time(html):
    began = time.process_time()
    htmltext.parse(html)
    assert time.process_time() - began < 5


def test_extract_of_odd_pages(spark, model):
    p = "A plain sentence of the article that goes on for a while, with commas and all. " * 6
    page = f"<html><body><nav><a href=/>home</a></nav><article><h1>Head</h1><p>{p}</p><p>{p}&amp; more</p></article></body></html>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "u", ""), (3, "u", "<p"), (4, "u", "<div a='"), (5, "u", page[:200] + "<x \" <!-- "), (6, "u", page * 300)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = sorted(((r.page_id, r.text, r.n_chars) for r in htmltext.extract(docs, model).collect()), key=str)
    by = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert by[1].startswith("Head\n\nA plain") and by[1].endswith("& more") and "home" not in by[1]
    assert by[2] == by[None] == "" and len(by[6]) >= 300 * len(by[1])
    assert htmltext.extract(docs.limit(0), model).count() == 0


def plain_form(seg):
    if re.fullmatch(r"[0-9]+", seg):
        out = "{n}"
    elif re.fullmatch(r"[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?", seg):
        out = "{date}"
    elif re.fullmatch(r"[0-9]+\.[A-Za-z]{1,5}", seg):
        out = "{n}" + seg[seg.rindex(".") :]
    else:
        out = re.sub(r"[0-9]+", "{n}", seg)
    return "/" + ("\\" if out.startswith("*") else "") + out


def plain_tree(urls, rules, smooth, reject):
    """Verdict and template of (host, path) by the whole method, node by node; for segments without hashes."""

    def judged(host, path):
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2] if fit else None

    def chi(b, m, c, n):
        under = (b + c) * (m + n - b - c) * m * n
        return (m + n) * (b * (n - c) - c * (m - b)) ** 2 / under if under else 0.0

    count = {}
    for host, path in urls:
        count[host, path] = count.get((host, path), 0) + 1
    label = {k: (n * (judged(*k) == "block"), n * (judged(*k) == "allow")) for k, n in count.items()}
    segs = {k: [s for s in k[1].split("/") if s] for k in count}
    domain = lambda host: ".".join(host.split(".")[-2:])
    shape = lambda k: "".join(map(plain_form, segs[k]))

    def share(keys, prior):
        b, a = (sum(label[k][i] for k in keys) for i in (0, 1))
        return (b + smooth * prior) / (b + a + smooth)

    prior = {}
    for k in count:
        everywhere = share([x for x in count if shape(x) == shape(k)], 0.5)
        prior[k] = share([x for x in count if shape(x) == shape(k) and domain(x[0]) == domain(k[0])], everywhere)

    template = {}

    def grow(keys, name, level):
        done = [k for k in keys if len(segs[k]) <= level]
        template.update(dict.fromkeys(done, name))
        kids = {}
        for k in keys:
            if len(segs[k]) > level:
                kids.setdefault(plain_form(segs[k][level]), []).append(k)
        pools = {}
        for c, own in kids.items():
            b, a = (sum(label[k][i] for k in own) for i in (0, 1))
            if a + b and not c.startswith("/{"):
                pool = pools.setdefault(b / (a + b), [0, 0, []])
                pool[0] += b
                pool[1] += a + b
                pool[2].append(c)
        groups = []
        for _, (b, m, names) in sorted(pools.items()):
            if groups and chi(groups[-1][0], groups[-1][1], b, m) <= urltree.ALIKE and chi(*groups[-1][2], b, m) <= urltree.ALIKE:
                groups[-1] = [groups[-1][0] + b, groups[-1][1] + m, groups[-1][2], groups[-1][3] + names]
            else:
                groups.append([b, m, (b, m), names])
        wild = {c: "/*" + (str(g) if g > 1 else "") for g, (_, _, _, names) in enumerate(groups, 1) if len(names) > 1 for c in names}
        below = {}
        for c, own in kids.items():
            if len(own) == 1 and c not in wild:
                template[own[0]] = name + "".join(map(plain_form, segs[own[0]][level:]))
            else:
                below.setdefault(wild.get(c, c), []).extend(own)
        for c, own in below.items():
            grow(own, name + c, level + 1)

    for host in {h for h, _ in count}:
        grow([k for k in count if k[0] == host], "", 0)
    out = {}
    for k in count:
        own = [x for x in count if x[0] == k[0] and template[x] == template[k]]
        purity = share(own, sum(prior[x] * count[x] for x in own) / sum(count[x] for x in own))
        out[k] = judged(*k) or ("block" if purity >= reject else "allow"), template[k], purity
    return out


def test_url_tree_equals_a_plain_one(spark):
    rng = random.Random(6)
    hosts = ["a.x.com", "b.x.com", "x.com", "c.y.net", "d.y.net", "e.z.org"]
    tops = ["en", "de", "es", "shop", "ka", "kb", "2024-01-02"]
    urls = []
    for _ in range(700):
        path = "/" + rng.choice(tops) + "".join("/" + rng.choice(["a", "b", "c", "*q", str(rng.randrange(40)), f"{rng.randrange(9)}.html", f"p{rng.randrange(3)}"]) for _ in range(rng.randrange(4)))
        urls.append((rng.choice(hosts), path + rng.choice(["", "/"])))
    rules = [("block", "x.com", "/en/"), ("allow", "a.x.com", "/en/7"), ("allow", "y.net", "/de/"), ("block", "z.org", "/ka/a"), ("block", "z.org", "/kb/b"), ("allow", "c.y.net", "/shop/c")]
    want = plain_tree(urls, rules, urltree.SMOOTH, urltree.REJECT)
    pages = spark.createDataFrame([(i, f"http://{h}{p}?q=1") for i, (h, p) in enumerate(urls)], "page_id long, url string")
    got = urltree.judge(pages, rules).collect()
    assert len(got) == len(urls)
    for r in got:
        verdict, template, purity = want[r.host, r.path]
        assert (r.verdict, r.template) == (verdict, template) and abs(r.purity - purity) < 1e-9
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_url_tree_rejects_pure_templates_only(spark):
    rows = [(i, f"http://a.com/en/{i}") for i in range(30)] + [(100 + i, f"http://a.com/fr/{i}") for i in range(9)]
    rules = [("block", "a.com", f"/en/{i}") for i in (1, 2)] + [("allow", "b.com", "/")]
    rows += [(200 + i, f"http://b.com/x{i}/p") for i in range(20)]
    got = {r.page_id: r for r in urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[5].verdict == "block" and got[5].rule is None and got[5].template == "/en/{n}"
    assert all(got[100 + i].verdict == "allow" for i in range(9))
    assert {got[200 + i].template for i in range(20)} == {"/x{n}/p"}


@pytest.mark.parametrize("others", [12, 13, 40])
def test_url_verdicts_do_not_turn_with_the_number_of_siblings(spark, others):
    urls = [f"http://www.example.com/en/{i}" for i in range(60)] + [f"http://www.example.com/s{'abcdefgh'[k % 8]}{'xyzuvw'[k // 8]}/{i}" for k in range(others) for i in range(3)]
    got = urltree.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {r.verdict for r in got if "/en/" not in r.path} == {"allow"}
    assert {r.template for r in got if "/en/" in r.path} == {"/en/{n}"} and len({r.template for r in got}) == others + 1


def test_url_tree_merges_like_branches_among_others_at_any_depth(spark):
    names = ["ka", "kb", "kc", "kd"]
    urls, rules = [], []
    for top in ("/", "/p/q/r/s/t/"):
        for name in [*names, "good", "free"]:
            urls += [f"http://h.com{top}{name}/{w}" for w in range(20)]
        rules += [("block", "h.com", f"{top}{name}/1") for name in names] + [("allow", "h.com", f"{top}good/1")]
    urls += ["http://h.com/*/x", "http://h.com/" + "/".join("d" * 300)]
    got = {(r.path): r for r in urltree.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    for top in ("/", "/p/q/r/s/t/"):
        by = {name: {got[f"{top}{name}/{w}"].template for w in range(20)} for name in [*names, "good", "free"]}
        assert len(set.union(*[by[n] for n in names])) == 1 and len(by["free"]) == 1 and len(by["good"]) == 1
        assert len({*by["ka"], *by["good"], *by["free"]}) == 3 and by["free"] == {f"{top}free/{{n}}"}
        assert all(got[f"{top}{n}/5"].verdict == ("block" if n in names else "allow") for n in [*names, "good", "free"])
    assert got["/*/x"].template == "/\\*/x" and got["/" + "/".join("d" * 300)].template == "/d" * 300


@pytest.mark.parametrize("rows_per_block", [4, 1024])
def test_top_k(spark, rows_per_block, monkeypatch):
    monkeypatch.setattr(topk.build_index, "__defaults__", (rows_per_block,))
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 5))
    data = [(i, [float(x) for x in centres[i % 6] * 0.4 + rng.normal(size=5) * 0.1]) for i in range(400)]
    data += [(1000 + i, data[7][1]) for i in range(120)]  # one very common vector
    odd = [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 5), (2150, [float("inf")] * 5), (None, data[1][1]), (2200, []), (2250, [0.1] * 3), (2300, [0.2] * 3), data[3], (50, data[9][1])]
    vectors = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5, n_pivots=4)
    found: dict[int, list] = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.vec_id, r.score))
    usable = data + [(2250, [0.1] * 3), (2300, [0.2] * 3), data[3], (50, data[9][1])]
    ints = [(i, np.floor(256 * np.float32(v).astype(np.float64)).astype(np.int64)) for i, v in usable]
    want = {}
    for q in {i for i, _ in ints if i % 50 == 0}:
        ranked = sorted((-int(y @ x), i) for j, y in ints if j == q for i, x in ints if i != q and len(x) == len(y))
        want[q] = [(i, -s) for s, i in ranked[:5]]
    assert found == want
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
