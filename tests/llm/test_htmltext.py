import random

from quarrymill.llm.htmltext import Block, blocks_of, extract, label_blocks, main_text, stop_density

PARA = "The house that stands by the river was built in the year of the flood and it has been there for all of us since then, as it was for them."
OTHER = "Every part of the engine is made of steel, and with the right tools it can be taken apart in an hour by one or two people at most."


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy it now, it is the best of all.</div><!-- x -->
    <article><h1>Head &amp; tail</h1><p><b>{PARA}<br><p>{OTHER}</p><p>Short one.</p><aside>By the way of it</aside>
    <section class="comments"><p>I like it, the text of this was good for me and for all the others in here too.</p></section></article>
    <form>Name of the user <input name="a"></form><footer>&copy; 2020</footer></body></html>"""
    assert main_text(page) == f"Head & tail\n\n{PARA}\n\n{OTHER}\n\nShort one."


def test_page_without_article():
    page = f"""<div><a href=1>One</a> <a href=2>Two</a></div><div>{PARA}</div><div>Short.</div><div>{OTHER}</div>
    <div>lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua</div>
    <div class='cookie-notice'>{PARA}</div><div>Mail: x@y</div>"""
    assert main_text(page) == f"{PARA}\n\nShort.\n\n{OTHER}"


def test_broken_markup():
    assert main_text(None) == "" and main_text("") == "" and main_text("<p") == "" and main_text("<script>x") == ""
    assert main_text(f"<article><p>{PARA} a < b &lt; c &am") == f"{PARA} a < b < c &am"
    assert main_text(f"<article><p>x<b>y</b>z\n\t {PARA}</artic") == f"xyz {PARA}"
    assert main_text(f"<article><p>{PARA}<br><br>{OTHER}") == f"{PARA}\n\n{OTHER}"
    assert main_text(f"<article><div title='a>b'>{PARA}&nbsp;&#233;&#x41;</div>") == f"{PARA} éA"
    assert main_text(f"</div></p><ARTICLE><P>{PARA}</P></ARTICLE>") == PARA


def test_second_pass_takes_nearest_decided():
    rng = random.Random(4)
    for _ in range(300):
        kinds = [rng.choice(["good", "bad", "short"]) for _ in range(rng.randint(1, 12))]
        text = {"good": PARA, "bad": "x" * 300, "short": "Tiny."}
        found = [Block(text=text[k]) for k in kinds]
        label_blocks(found)
        for i, b in enumerate(found):
            if kinds[i] != "short":
                assert b.label == kinds[i]
                continue
            near = sorted((abs(i - j), kinds[j]) for j in range(len(kinds)) if kinds[j] != "short")
            first = {k for d, k in near if d == near[0][0]} if near else {"bad"}
            assert b.label == (first.pop() if len(first) == 1 else "bad")


def test_stop_words_ignore_marks_and_case():
    assert stop_density("THE!! OF### x") == 2 / 3
    assert stop_density("") == 0 and stop_density("...") == 0


def test_very_long_page_and_many_tags():
    page = "<article>" + "".join(f"<p>{PARA} {i}</p>" for i in range(3000)) + "</article>"
    assert main_text(page).count("\n\n") == 2999
    assert len(blocks_of("<div>" * 2000 + "x" + "</div>" * 2000)) == 1


def test_table(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", f"<p>{PARA}</p>"), (1, "u", None)]
    pages = spark.createDataFrame([(*r, 3, "t") for r in rows], "page_id long, url string, html string, N_chars int, text string")
    got = extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "", 0), (1, "u", "", 0), (2, None, "", 0), (None, "v", PARA, len(PARA))], key=str)
    assert extract(pages.limit(0)).count() == 0


def test_driver_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = extract(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    assert all(r.text for r in rows) and not any("©" in r.text for r in rows)


def test_dropped_elements_without_an_end_tag():
    said = "The house that we had seen in the morning was on the other side of the river, and there was no way to it but by the old bridge."
    article = f"<article><p>{said}</p></article>"
    assert main_text(f"<html><head><title>The title</title><script>'<p>'</script><body>{article}</body></html>") == said
    for name in ("button", "select", "object", "canvas", "audio", "video", "map", "datalist", "svg", "noscript"):
        assert main_text(f"<html><body><div><{name}>Share</div>{article}</body></html>") == said, name
        assert main_text(f"<html><body><{name}>Share{article}</body></html>") == said, name
    assert main_text(f"<body><button>Share{article}<button>More</button></body>") == said
    assert main_text(f"<body><noscript>{article}</noscript><article><p>{said} Yes.</p></article></body>") == said + " Yes."
    assert main_text(f"<body>{article}<script>var a = 1; <p>{said}</p></body>") == said
