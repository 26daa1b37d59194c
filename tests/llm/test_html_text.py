import random

from seqforge.llm import html_text as H

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<nav><a>Home</a> <a>About</a></nav><div class="cookie-banner">We use cookies</div>
<article><h1>A &amp; B</h1><p>First   line<br>goes <b>on</b>.</p><script>var x = "<p>no</p>";</script><div class="ad">Buy</div><p>Caf&eacute; &#x41;</p>
<form><input value="q">Send</form></article><section class="comments"><p>nice!</p></section><footer>(c)</footer></body></html>"""


def rows(spark, got):
    return [(r["page_id"], r["text"]) for r in got.collect()]


def test_article(spark):
    df = spark.createDataFrame([(1, "https://a.example/x", PAGE, "e")], "page_id long, url string, html string, text string")
    assert rows(spark, H.extract(df)) == [(1, "A & B\nFirst line goes on.\nCafé A")]


def test_edges(spark):
    data = [(1, None, None), (2, "u", ""), (3, "http://h/", "plain words"), (None, "http://h/", "<p>cut <b"), (3, "http://h/", "plain words"), (4, "http://h/", "<p>" + "word " * 50_000), (5, "x", "<script>only</script>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = sorted(map(str, rows(spark, H.extract(df))))
    assert got == sorted(map(str, [(1, ""), (2, ""), (3, "plain words"), (3, "plain words"), (None, "cut"), (4, ("word " * 50_000).strip()), (5, "")]))
    assert H.extract(df.limit(0)).count() == 0


def test_unmarked_boilerplate_of_a_host_goes(spark):
    rnd = random.Random(4)
    own = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30))
    bodies = [own() for _ in range(12)]
    data = [(i, f"https://site.example/{i}", f"<div class=top>Some menu entries that all pages share here</div><div class=body><p>{b}</p></div><div class=low>All rights reserved by the owners of this site</div>") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    assert dict(rows(spark, H.extract(df))) == dict(enumerate(bodies))


def test_covered_tokens_against_plain_counting():
    rnd = random.Random(9)
    for _ in range(30):
        streams = [[rnd.choice("abcd") for _ in range(rnd.randrange(0, 60))] for _ in range(6)]
        want = []
        for s in streams:
            inside = [False] * len(s)
            for i in range(len(s) - H.RUN + 1):
                run = s[i : i + H.RUN]
                pages = sum(any(t[k : k + H.RUN] == run for k in range(len(t) - H.RUN + 1)) for t in streams)
                if pages >= H.MIN_PAGES:
                    inside[i : i + H.RUN] = [True] * H.RUN
            want.append(inside)
        assert [x.tolist() for x in H.covered_tokens(streams)] == want


def words(rnd, n):
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))


def pages_df(spark, data):
    return spark.createDataFrame([(i, "https://site.example/", h) for i, h in enumerate(data)], "page_id long, url string, html string")


def test_runs_decide_within_declared_articles(spark):
    """Boilerplate under an untelling class of an article goes; copied articles and text beside a teaser stay."""
    rnd = random.Random(11)
    notice = "this text was first printed in our paper and may not be sold or passed on"
    bodies = [words(rnd, 60) for _ in range(4)]
    data = [f"<article><p>{b}</p><div class=x>{notice}</div></article>" for b in bodies]
    copied, teaser, beside = words(rnd, 60), "a short teaser", words(rnd, 80)
    data += [f"<nav>{words(rnd, 9)}</nav><article><p>{copied}</p><p>{words(rnd, 5)}</p></article>" for _ in range(4)]
    data.append(f"<article>{teaser}</article><div>{beside}</div>")
    got = dict(rows(spark, H.extract(pages_df(spark, data))))
    assert [got[i] for i in range(4)] == bodies
    assert all(got[i].startswith(copied) for i in range(4, 8))
    assert got[8] == f"{teaser}\n{beside}"


def test_unique_text_stays(spark):
    """Unique paragraphs beside a notice of the same path, pages with copies, and common phrases."""
    rnd = random.Random(12)
    notice = "please note that this shop is closed on all public holidays and that orders are sent on the next working day"
    bodies = [f"{words(rnd, 7)} as soon as it can be {words(rnd, 7)}" for _ in range(4)]
    alone = words(rnd, 40)
    data = [f"<p>{notice}</p><p>{b}</p>" for b in bodies] + [f"<p>{alone}</p>"] * 3
    got = dict(rows(spark, H.extract(pages_df(spark, data))))
    assert got == dict(enumerate(bodies + [alone] * 3))


def test_boilerplate_is_counted_over_the_whole_host(spark, monkeypatch):
    """Five pages of a host of 1,500 share a passage; it goes wherever they are dealt, and by either way of telling pages."""
    rnd = random.Random(13)
    notice = "the editors of this page take no liability for what is said on pages that are linked from here"
    bodies = [words(rnd, 20) for _ in range(1500)]
    data = [f"<div><p>{b} {notice if i % 300 == 0 else ''}</p></div>" for i, b in enumerate(bodies)]
    df = pages_df(spark, data)
    assert dict(rows(spark, H.extract(df))) == dict(enumerate(bodies))
    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(H, "SEGMENTS", 2)
    assert dict(rows(spark, H.extract(df))) == dict(enumerate(bodies))


def test_names_and_unclosed_containers(spark):
    """A class of content that also names sharing, and a container of other media that nothing closes, hide nothing."""
    data = ['<article><div class="content share-text"><p>Body text here</p></div></article>', "<article><p>begins<textarea>draft<p>goes on</p></article>", '<article><div class="social-share">x</div><p>told</p></article>']
    assert dict(rows(spark, H.extract(pages_df(spark, data)))) == {0: "Body text here", 1: "beginsdraft\ngoes on", 2: "told"}


def test_runs_end_at_region_borders(spark):
    """A short last paragraph that articles share, before a footer that the host shares, is no run together with it; and
    longer passages that articles quote stay as well."""
    rnd = random.Random(14)
    last, quote = "so it was and so it will be", words(rnd, 30)
    bodies = [words(rnd, 40) for _ in range(8)]
    data = [f"<article><p>{b}</p><p>{quote}</p><p>{last}</p></article><footer>site example all rights reserved by us imprint privacy terms contact</footer>" for b in bodies]
    assert dict(rows(spark, H.extract(pages_df(spark, data)))) == {i: f"{b}\n{quote}\n{last}" for i, b in enumerate(bodies)}


def test_hosts_without_articles_by_precision_and_recall(spark):
    """Hosts that mark nothing: blocks in bare divs, menus and footers between unique text. Words that should stay and words
    that do, over all pages."""
    rnd = random.Random(15)
    data, want = [], []
    for host in range(6):
        top, low, aside = words(rnd, 14), words(rnd, 25), words(rnd, 8)
        for page in range(20):
            body = [words(rnd, rnd.randrange(5, 60)) for _ in range(rnd.randrange(1, 6))]
            blocks = [top, *body[:1], *([aside] if page % 2 else []), *body[1:], low]
            data.append((len(data), f"https://h{host}.example/{page}", "".join(f"<div>{b}</div>" for b in blocks)))
            want.append("\n".join(body))
    got = dict(rows(spark, H.extract(spark.createDataFrame(data, "page_id long, url string, html string"))))
    right = sum(len(set(got[i].split()) & set(w.split())) for i, w in enumerate(want))
    assert right >= 0.999 * sum(len(set(w.split())) for w in want)  # recall
    assert right >= 0.99 * sum(len(set(t.split())) for t in got.values())  # precision
