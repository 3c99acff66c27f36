from foliometry.llm.html_extraction import extract_pages
from foliometry.llm.html_pages import best_container, extract, parse

DIVS = """<!DOCTYPE html><html><head><title>t</title></head><body class="has-sidebar"><header><h1>Site</h1></header><!-- x --><div id=wrap>
<div class="cookie-notice">We use cookies</div><div class="main-col"><div class="post post-{n}"><h1>Title &amp; more</h1><div class=post-body><p>One&nbsp;two
 <a href=x>three</a><p>Four<br>five<ul><li>a<li>b</ul><script>if(a<b){{"</div>"}}</script><div class="ad">buy</div><p>{body}</p></div></div>
<div class="comments"><p>First! {body}</p></div></div><div class=sidebar><p>side</p></div></div><footer>f</footer></body></html>"""
BODY = "Long prose that goes on and on, with many words in each of its sentences."
WANTED = f"Title & more\nOne two three\nFour five\na\nb\n{BODY}"


def test_container_without_article():
    page = parse(DIVS.format(n=7, body=BODY))
    assert page.nodes[best_container(page)].path.endswith(">div.post.post-#")
    assert extract(page, []) == WANTED
    assert extract(page, [">html>body.has-sidebar>div>div.sidebar", page.nodes[best_container(page)].path]) == WANTED


def test_broken_markup():
    assert extract(parse("<article><p><b>A &lt;b&gt;<br><p>B</i> c<table><tr><td>1<td>2<tr><td>3</table><!-- open"), []) == "A <b>\nB c\n1\n2\n3"
    assert extract(parse("plain & simple"), []) == "plain & simple"
    assert extract(parse("<script>var x = '</p>'"), []) == ""
    assert extract(parse(""), []) == ""


def test_host_consensus(spark):
    small = "<html><body><div class=main-col><div class='post post-9'><p>Brief</p></div><div class=extra><p>This block is much longer than the post itself, on this one page.</p></div></div></body></html>"
    other = "<html><body><div class=main-col><div class='post post-{n}'><h1>T</h1><p>" + BODY + "</p></div><div class=extra><p>x</p></div></div></body></html>"
    rows = [(k, f"https://User@Host.example:8080/{k}", other.format(n=k), "q") for k in range(5)]
    rows += [(5, "http://host.example/5", small, "q"), (6, None, None, "q"), (7, "", "", "q"), (8, "no url", "<p>alone", "q"), (8, "no url", "<p>alone", "q")]
    rows += [(9, "http://long.example/", "<article>" + f"<p>{BODY}</p>" * 3_000 + "</article>", "q")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    got = {r["page_id"]: r for r in extract_pages(pages).collect()}
    assert extract_pages(pages).count() == len(rows)
    assert got[0]["text"] == f"T\n{BODY}"
    assert got[5]["text"] == "Brief"
    assert (got[6]["text"], got[6]["n_chars"], got[7]["text"], got[8]["text"]) == ("", 0, "", "alone")
    assert got[9]["n_chars"] == 3_000 * (len(BODY) + 1) - 1
    assert extract_pages(pages.where("page_id < 0")).count() == 0


def test_prose_beside_the_container_stays():
    intro = "This paragraph opens the article and stands in a block of its own."
    links = "<div class=more><a href=x>Another article of this site with a long title</a></div>"
    page = parse(f"<body><div class=intro><p>{intro}</p></div><div class=body><p>{BODY * 6}</p></div>{links}</body>")
    assert extract(page, []).startswith(f"{intro}\n{BODY}")
    page = parse(f"<body><div class=col><p>{BODY * 6}</p></div>{links}</body>")
    assert extract(page, []) == BODY * 6
    spread = parse(f"<body><div class=post><div class=text><p>{BODY}</p></div><div class=more><p>{BODY}</p></div></div></body>")
    assert extract(spread, [">body>div.post>div.text"]) == f"{BODY}\n{BODY}"


def test_ambiguous_names_inside_the_article():
    inside = (
        "<h1 class=page-header>Title</h1><p>{b}</p><section id=discussion><h2 class=article-header>Discussion</h2><p>{b}</p></section>"
        "<section id=related-work><p>Work <a href=x>one</a> came first.</p></section><div class=social-policy><p>Policy text.</p></div>"
        "<p id=search-methods>We <span class=notice>searched</span> where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p>"
        "<div class=share><a href=x>Share this</a> now</div><div class=related><a href=x>Other article</a></div><p>End<span class=share><a href=x>Post</a></span></p>"
    ).format(b=BODY)
    wanted = f"Title\n{BODY}\nDiscussion\n{BODY}\nWork one came first.\nPolicy text.\nWe searched where x=2 holds.\nEnd"
    page = f"<body><div class=page-header><p>{BODY * 3}</p></div>{{}}<div class=discussion><p>{BODY}</p></div></body>"
    assert extract(parse(page.format(f"<article>{inside}</article>")), []) == wanted
    assert extract(parse(page.format(f"<div class=post>{inside}</div>")), []) == wanted
