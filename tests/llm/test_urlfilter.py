import duckdb
import pytest

from quarrymill.llm.urlfilter import RULES, judge_urls, oracle


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    path = rest[cut:]
    end = min([i for i in map(path.find, "?#") if i >= 0], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path[:end]


def rule(host, path):
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if f".{host}".endswith(f".{h}") and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_by_plain_reading(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in judge_urls(pages).collect():
        assert (r.host, r.path) == split(urls[r.page_id])
        name, verdict = rule(r.host, r.path)
        assert r.rule == name and (verdict is None or r.verdict == verdict)


PAGES = [
    (1, "http://a.net/x", '<link rel="canonical" href="http://b.com/de/y">'),  # alias of a blocked address
    (2, "http://c.net/x", '<meta http-equiv="refresh" content="0; url=http://a.net/x?utm_source=q">'),  # two steps away
    (3, "https://www.a.net/x/#top", None),  # the address of 1 in other dress
    (4, "http://d.net/", "<link href='http://e.org/z' rel=canonical>"),  # allowed alias
    (5, "http://e.org/z", '<LINK REL="canonical" HREF="http://f.com/de/q">'),
    (6, "http://f.com/de/q", None),  # its own rule stays
    (7, "http://g.net/fr", "rel=canonical in text"),
    (8, None, "<link rel=canonical href=http://b.com/de/y>"),
    (9, "no scheme", ""),
    (10, "HTTP://EXAMPLE.ORG/es/1?x#y", None),
    (10, "HTTP://EXAMPLE.ORG/es/1?x#y", None),
    (11, "http://xexample.org/es/", None),
    (12, "://", None),
    (None, "http://u@H.com:80?x=/de/", None),
    (13, "http://h.com/de", None),  # a rule fits with a closing slash only: its alias decides
    (14, "http://h.com/de/", None),
    (15, "https://r.net/a/b?q", '<link rel="canonical" href="/y">'),  # against the page's own address
    (16, "https://r.net/y", '<meta http-equiv=refresh content="1;url=//B.com/de/y">'),
    (17, "https://r.net/a/c", '<link rel=canonical href="./b?q">'),
    (18, "https://r.net/z", '<!-- <link rel=canonical href="/y"> --><script>"<link rel=canonical href=/y>"</script>'),
    (19, "https://r.net/w", '<link rel=canonical href="mailto:/y"><link rel=canonical href="#y">'),
    (20, "https://r.net/y?k", '<link rel=canonical href="?k=1">'),
    (21, "https://r.net/y?k=1", '<link rel=canonical href="http://b.com/de/y">'),
]


def expected():
    blocked = {1, 2, 3, 6, 10, 13, 14, 15, 16, 17, 20, 21}
    return sorted([(i, *split(u), rule(*split(u))[0], "block" if i in blocked else "allow") for i, u, _ in PAGES], key=str)


def test_aliases_and_edges(spark):
    pages = spark.createDataFrame([(*r, 5, "v") for r in PAGES], "page_id long, url string, html string, Host int, verdict string")
    assert sorted(map(tuple, judge_urls(pages).collect()), key=str) == expected()
    assert judge_urls(pages.limit(0)).count() == 0


def test_oracle_agrees_on_aliases(tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    assert sorted(con.execute(oracle()).fetchall(), key=str) == expected()


@pytest.mark.parametrize("given", [[("http://q.net/1", "http://b.com/de/y")], []])
def test_redirect_table(spark, given):
    pages = spark.createDataFrame([(1, "http://q.net/1")], "page_id long, url string")
    moved = spark.createDataFrame(given, "source string, target string")
    assert judge_urls(pages, html_col=None, redirects=moved).first().verdict == ("block" if given else "allow")
