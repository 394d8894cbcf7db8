import html
import random
import time
import re

import pytest
from pyspark.sql import functions as F

from gridframe.llm import html_text as ht
from gridframe.llm import url_filter as uf


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    None, "", "nothing", "http://", "https://a.Example.COM/en/7#x", "http://example.com/en/7", "http://example.com/en/", "http://com/en/", "http://xcom/en/",
    "http://a.net/de/8", "http://example.net/de/8?x", "http://b.example.net/de/81", "http://b.net/fr", "http://é.Org/es/1", "http://ÉA.org?es/", "x://org#/es/",
    "a://b://org/es/", "http://notexample.com/en/7", "http://a\nb.org/es/\nx",
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules(spark):
    got = uf.judge(pages(spark, [(i, u, None) for i, u in enumerate(URLS)])).orderBy("page_id").collect()
    for r, u in zip(got, URLS):
        host, path, rule, verdict = brute_rule(u)
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert verdict is None or r.verdict == verdict


def pagerank(edges, seeds, damping, rounds):
    rank = {h: (1 - damping) * s for h, s in seeds.items()}
    start = dict(rank)
    for _ in range(rounds):
        new = dict(start)
        for (a, b), share in edges.items():
            new[b] = new.get(b, 0) + damping * share * rank.get(a, 0)
        rank = new
    return rank


def test_propagation(spark):
    r = random.Random(2)
    hosts = [f"h{i}.net" for i in range(12)] + ["bad.example.org", "good.net"]
    links = [(r.choice(hosts), r.choice(hosts)) for _ in range(60)]
    rows = [(i, f"http://{a}/x", f'<a class="k" href="https://{b}/y">t</a><A HREF=/local>') for i, (a, b) in enumerate(links)]
    rows += [(900, "http://bad.example.org/es/1", None), (901, "http://good.net/de/1", "")]
    got = {x.host: x.distrust for x in uf.judge(pages(spark, rows)).collect()}
    count = {}
    for a, b in links:
        if a != b:
            count[a, b] = count.get((a, b), 0) + 1
    out = {a: sum(n for (x, _), n in count.items() if x == a) for a, _ in count}
    into = {b: sum(n for (_, x), n in count.items() if x == b) for _, b in count}
    trust = pagerank({e: n / out[e[0]] for e, n in count.items()}, {h: float(h == "good.net") for h in hosts}, uf.DAMPING, 200)
    bad = pagerank({(b, a): n / into[b] for (a, b), n in count.items()}, {h: float(h == "bad.example.org") for h in hosts}, uf.DAMPING, 200)
    for h in got:
        t, d = trust.get(h, 0), bad.get(h, 0)
        assert got[h] == pytest.approx(d / (t + d) if t + d else 0, abs=1e-4)


def test_propagation_to_a_tolerance(spark):
    edges = spark.createDataFrame([(f"h{i}", f"h{(i + 1) % 20}", 1.0) for i in range(20)], "src string, dst string, share double")
    seeds = spark.createDataFrame([("h0", 3.0), ("h5", 1.0), ("far", 0.0)], "host string, seed double")
    want = pagerank({(f"h{i}", f"h{(i + 1) % 20}"): 1.0 for i in range(20)}, {"h0": 3.0, "h5": 1.0}, uf.DAMPING, 400)

    def off(**options):
        got = {x.host: x.rank for x in uf.propagate(edges, seeds, **options).collect()}
        return sum(abs(want[h] - got.get(h, 0)) for h in want), got

    lost, few = off(rounds=8)
    assert lost == pytest.approx(4 * uf.DAMPING**9) and "h15" not in few
    lost, all_ = off(tolerance=0.05)
    assert lost <= 4 * 0.05 and all_["h15"] > 0
    ended = uf.propagate(edges.where("src = 'h0'"), seeds, tolerance=1e-30)  # stops once nothing moves
    assert {x.host: x.rank for x in ended.collect()} == pytest.approx({"h0": 0.45, "h1": 0.3825, "h5": 0.15, "far": 0.0})
    assert uf.DAMPING ** (uf.rounds_for(uf.DAMPING, 1e-6) + 1) <= 1e-6 < uf.DAMPING ** uf.rounds_for(uf.DAMPING, 1e-6)


def test_long_chain(spark):
    """Every host of a chain of 50 that ends at a blocked one is blocked."""
    rows = [(i, f"http://h{i}.test/x", f"<a href='//h{i + 1}.test/y'>n</a>" if i < 49 else "<a href='http://foul.example.org/z'>n</a>") for i in range(50)]
    rows += [(50, "http://foul.example.org/es/1", None), (51, "http://lone.test/", "<a href=/x>x</a>")]
    got = {x.page_id: x.verdict for x in uf.judge(pages(spark, rows)).collect()}
    assert [got[i] for i in range(50)] == ["block"] * 50 and got[51] == "allow"


LINKS = [
    ("<a href='https://B.example/x'>", "b.example"),
    ("<a class=k href=//c.example/y>", "c.example"),
    ("<base href='http://d.example/dir/'><a href='page'>", "d.example"),
    ("<base href=//e.example/><a href=?q=http://z.example/>", "e.example"),
    ("<base href='/dir/'><a href='page'>", None),
    ("<a href='/go?u=http://z.example/'>", None),
    ("<a href='mailto:x@z.example'><a href='javascript:u(\"http://z.example\")'>", None),
    ("<a data-href='http://z.example/'>", None),
    ("<A\nHREF = 'ftp://f.example:21'>", "f.example:21"),
    ("<abbr href='http://z.example/'>", None),
]


def test_links(spark):
    got = {x.src: x.dst for x in uf.host_edges(pages(spark, [(i, f"http://p{i}.test/", h) for i, (h, _) in enumerate(LINKS)])).collect()}
    assert [got.get(f"p{i}.test") for i in range(len(LINKS))] == [h for _, h in LINKS]


def test_graph_equals_sql(spark, tmp_path):
    """A generated graph of links, with hubs, over all of the SQL."""
    import duckdb

    r = random.Random(11)
    hosts = [f"n{i}.{r.choice(['com', 'net', 'org', 'test'])}" for i in range(150)] + ["a.example.com", "b.example.net", "c.example.org"]
    rows = []
    for i in range(900):
        links = "".join(f'<a href="{r.choice(["http:", "https:", ""])}//{r.choice(hosts[:5] if r.random() < 0.3 else hosts)}/p{i}">x</a>' for _ in range(r.randrange(5)))
        rows.append((i, f"https://{r.choice(hosts)}/{r.choice(['en', 'de', 'es', 'fr'])}/{i}", links))
    df = pages(spark, rows)
    df.toPandas().to_parquet(tmp_path / "pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = c.execute(uf.ORACLE_SQL).df().set_index("page_id").verdict.to_dict()
    got = {x.page_id: x.verdict for x in uf.judge(df).collect()}
    assert got == want and {"allow", "block"} == {got[i] for i in got}


def test_long_pages(spark):
    for text in ("<a " * 100_000, "<a href=" * 50_000, "<a href='//x.test/'>" * 20_000):
        assert uf.judge(pages(spark, [(1, "http://a.test/", text)])).first().verdict == "allow"


def test_url_awkward_tables(spark):
    df = pages(spark, [(1, "http://a.org/es/", None), (1, "http://a.org/es/", None), (None, None, None)]).withColumn("host", F.lit(1)).withColumn("rule", F.lit("x"))
    assert sorted((str(x.page_id), x.verdict) for x in uf.judge(df).collect()) == [("1", "block"), ("1", "block"), ("None", "allow")]
    assert uf.judge(df.limit(0)).count() == 0


def page(article, extra="", tail="", head="<title>T &amp; t</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}<script>var a='</p>';</script></head><body>{extra}<article>{article}</article>{tail}</body></html>"


CASES = [
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    (page("<h1>Head&nbsp;line</h1><p>a <b>b</b>c<br>d\n\n e</p><p>&lt;tag&gt; &#233; &copy;"), "Head line a bc d e <tag> é ©"),
    (page("<p>x</p>", "<nav><ul><li><a href='/a'>menu</a></li></ul></nav><div class='ad'>buy</div>"), "x"),
    (page("<p>x</p><aside>side</aside><div class='comments'><p>first!</p><div>nested</div></div><p>y</p>"), "x y"),
    (page("<header><h1>Title</h1></header><p>y</p>", "<header><div>site</div></header>", "<footer>&copy; f</footer>"), "Title y"),
    (page("<form><input name=q><button>go</button></form><p>z</p><!-- <p>no</p> -->", "<div id='cookie-notice'>we use</div>"), "z"),
    ("<body><div>open <i>text</i></div><footer>f</footer><p>more", "open text more"),
    (page("<p class=ad>buy<p>kept</p><p hidden>no</p>"), "kept"),
    (page("<p>1 < 2 & 3 > 2</p>"), "1 < 2 & 3 > 2"),
    ("<main role='main'><p>in main</p></main><p>out</p>", "in main"),
    ("<head><title>x<body><p>y", "y"),
    (page("<p class='ad'>buy<div>kept</div>"), "kept"),
    (page("<p>kept<p id=ad>buy"), "kept"),
    ("<p title='a>b'>quoted</p>", "quoted"),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_one_page(source, text):
    assert ht.extract([(1, source or "")]) == [text]


def test_repeated_runs_of_open_blocks():
    story = [" ".join(f"own{i}x{j}" for j in range(9)) for i in range(5)]
    menu = "<div>Home News Sport Weather About Contact Login</div>"
    sources = [(i, f"<body>{menu}<p>{story[i]}</p><div>Copyright by the editors of this paper 2020</div></body>") for i in range(5)]
    assert ht.extract(sources) == story
    assert "Home" in ht.extract(sources[:2])[0]  # on too few pages to tell
    assert "Home" in ht.extract([(7, sources[0][1])] * 5)[0]  # copies of one page are one page


def test_articles_may_quote_one_another():
    same = "<p>the very same paragraph of many words stands in each of them</p>"
    assert ht.extract([(i, page(same)) for i in range(5)]) == ["the very same paragraph of many words stands in each of them"] * 5


def test_repeated_runs_decide_beside_an_article():
    menu = "<div>Home News Sport Weather About Contact Login</div>"
    own = [f"headline{i} of story{i}" for i in range(4)]
    sources = [(i, f"<body>{menu}<div>{own[i]}</div><article><p>part{i}</p></article><div>rest{i}</div>{menu}</body>") for i in range(4)]
    assert ht.extract(sources) == [f"{own[i]} part{i} rest{i}" for i in range(4)]
    assert ht.extract(sources[:2]) == ["part0", "part1"]  # on too few pages to tell
    assert ht.extract(sources[:2], tells=True)[0].startswith("Home")  # the host has more pages


def test_main_text(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in ht.main_text(df, shard_pages=3).collect()}
    assert len(got) == df.count()
    for r in df.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", body))).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_shards_do_not_show(spark):
    r = random.Random(5)
    notice = [f"notice {k} is on a few pages of this host alone" for k in range(4)]
    rows = []
    for i in range(90):
        own = " ".join(f"w{r.randrange(10**6)}" for _ in range(8))
        extra = f"<div>{notice[i % 4]}</div>" if i % 15 < 4 else ""
        closed = f"<footer>{notice[0]}</footer>" if i % 30 == 20 else ""
        article = f"<article>in {own}</article>" if i % 3 == 0 else ""
        rows.append((i if i % 10 else None, f"http://{'one' if i < 80 else 'two'}.org/{i}", f"<body>{extra}<p>{own}</p>{article}{closed}</body>"))
    rows += [(5, "http://one.org/other", rows[5][2]), (7, "http://one.org/again", "<p>seen by one page that has many urls</p>"), *[(7, f"http://one.org/{k}", "<p>seen by one page that has many urls</p>") for k in range(5)]]
    df = pages(spark, rows)
    whole = sorted((str(x.page_id), x.url, x.text) for x in ht.main_text(df, shard_pages=1000).collect())
    assert sum("notice" in x[2] for x in whole) < 5 and sum("seen by" in x[2] for x in whole) == 6
    for n in (40, 4):
        assert sorted((str(x.page_id), x.url, x.text) for x in ht.main_text(df, shard_pages=n).collect()) == whole


@pytest.mark.parametrize("part", ["<p ", '<p "', "<p '\"> ", "<script ", "<!", '<p "x>', "<", "</script", "<a '", "&#1", "<div class='a b "])
def test_tokens_take_linear_time(part):
    start = time.perf_counter()
    ht.blocks(part * (1_000_000 // len(part)))
    ht.blocks(part * (1_000_000 // len(part)) + ">")
    assert time.perf_counter() - start < 20


def naive_repeated(streams, names, min_run, min_pages):
    seen = {}
    for s, n in zip(streams, names):
        for i in range(len(s) - min_run + 1):
            seen.setdefault(tuple(s[i : i + min_run]), set()).add(n)
    out = []
    for s in streams:
        hit = [False] * len(s)
        for i in range(len(s) - min_run + 1):
            if len(seen[tuple(s[i : i + min_run])]) >= min_pages:
                hit[i : i + min_run] = [True] * min_run
        out.append(hit)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_repeated_tokens_against_brute_force(seed):
    r = random.Random(seed)
    passages = [[r.choice("abcd") for _ in range(r.randrange(3, 9))] for _ in range(4)]
    streams, names = [], []
    for i in range(r.randrange(1, 30)):
        stream = []
        for _ in range(r.randrange(6)):
            stream += r.choice(passages) if r.random() < 0.6 else [r.choice("abcdefgh") for _ in range(r.randrange(5))]
        streams.append(stream)
        names.append(r.choice([i, None, 0]))
    min_run, min_pages = r.choice([(2, 2), (4, 3), (6, 3)])
    got = ht.repeated_tokens(streams, names, min_run, min_pages)
    assert [x.tolist() for x in got] == naive_repeated(streams, names, min_run, min_pages)


def test_pages_without_main_elements(spark):
    """Pages of the table stripped of every name that tells what an element is: the array alone separates."""
    import duckdb

    rows = duckdb.sql("SELECT page_id, html, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY 1").fetchall()
    host = max({h for _, _, h in rows}, key=lambda h: sum(x == h for _, _, x in rows))
    menu = "<div><ul>" + "".join(f"<li>entry {i} of the menu</li>" for i in range(8)) + "</ul></div>"
    opened, want = [], []
    for i, h, x in rows:
        if x == host:
            inner = re.search(r"(?s)<article>.*</article>", h)[0]
            opened.append((i, f"<html><body>{menu}<div class='c{i % 3}'>{inner.replace('article>', 'div>')}</div><div>all rights of this text are reserved by the {host} company</div></body></html>"))
            want.append((i, " ".join(t for _, t in ht.blocks(inner)).split()))
    assert len(opened) >= 5
    for (i, words), text in zip(want, ht.extract(opened)):
        got = text.split()
        assert "menu" not in got and "reserved" not in got
        assert len(got) >= 0.8 * len(words) and not set(got) - set(words)  # nothing but the article, and most of it


def test_html_awkward_tables(spark):
    df = pages(spark, [(1, None, None), (1, "http://a.b/", "<p>x"), (None, "u", "<p>y")]).withColumn("host", F.lit(1)).withColumn("salt", F.lit("x"))
    assert sorted(r.text for r in ht.main_text(df).collect()) == ["", "x", "y"]
    assert ht.main_text(df.limit(0)).count() == 0
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000 + "<p " * 20_000
    assert ht.main_text(pages(spark, [(1, "u", deep)])).first().text.startswith("deep")
