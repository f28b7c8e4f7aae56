"""Pages as they are found: doubtful names, forms around whole pages, other scripts, and odd addresses."""

import pytest

from loadlens.llm import warc
from loadlens.llm.html_extract import extract

P = "The house by the river was built in the year of the flood and it has stood there ever since, with a garden that runs down to the water and a wall of old stone."
Q = "It was sold to a family of millers who kept it for a hundred years, and they were the ones that planted the trees which you can see from the road to the town."
SAID = "I have been to this house and I can say that it is one of the best in the whole valley, but the road to it is not good at all in the winter months."
ARTICLE = f"<p>{P}</p><p>{Q}</p>"


@pytest.mark.parametrize("name", ["user-comments", "reader-comments", "fb-comments", "post-comments", "comment_thread", "comment-body", "commentsWrap", "replyList", "discussion-thread", "sponsored-post", "ad-slot-1", "adsbygoogle", "dfp-ad", "gpt-ad", "leaderboard-ad", "paywall-message"])
@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("mark", ["class", "id"])
def test_doubtful_parts_drop_out(name, inside, mark):
    part = f'<div {mark}="{name}"><p>{SAID}</p></div>'
    page = f"<body><article>{ARTICLE}{part}</article></body>" if inside else f"<body><div>{ARTICLE}</div>{part}</body>"
    assert extract(page) == f"{P}\n{Q}"


def test_long_comments_do_not_outweigh_an_article():
    comments = "".join(f'<article class="comment-body"><p>{SAID} {i}</p></article>' for i in range(9))
    assert extract(f"<body><main>{ARTICLE}</main><section id='readerComments'>{comments}</section></body>") == f"{P}\n{Q}"


def test_a_doubtful_name_around_the_whole_page():
    assert extract(f'<body><div class="has-ads no-comments layout"><div class="text">{ARTICLE}</div></div></body>') == f"{P}\n{Q}"
    assert extract(f'<body><article class="comments-open">{ARTICLE}</article></body>') == f"{P}\n{Q}"


@pytest.mark.parametrize("inner", [f"<article>{ARTICLE}</article>", f"<div>{ARTICLE}</div>"])
def test_a_form_around_the_whole_page(inner):
    page = f'<body><form action="x"><input type="hidden" value="y"><label>Search here</label><button>Go</button>{inner}<div class="user-comments"><p>{SAID}</p></div></form></body>'
    assert extract(page) == f"{P}\n{Q}"


def test_a_form_beside_the_text_drops_out():
    assert extract(f"<body><div>{ARTICLE}</div><form><p>{SAID}</p><label>Name</label></form></body>") == f"{P}\n{Q}"


def test_other_scripts():
    russian = "Дом у реки был построен в год большого наводнения и с тех пор стоит там, а сад спускается к самой воде реки."
    chinese = "河边的房子是在发大水的那一年建成的，从那以后它就一直矗立在那里，花园一直延伸到水边，四周是古老的石墙。后来它被卖给了一个磨坊主家庭，他们住了一百年，种下了从通往镇上的路上就能看到的那些树，每年春天都开满了花，邻居们都来看。"
    assert extract(f"<body><div><p>{russian}</p><p>{russian}</p></div><ul><li><a href=x>Меню</a></li></ul></body>") == f"{russian}\n{russian}"
    for page in (f"<body><div><p>{chinese}</p><p>{chinese}</p></div></body>", f"<body><article><p>{chinese}</p><p>{chinese}</p></article></body>"):
        assert extract(page) == f"{chinese}\n{chinese}"


def test_latin_text_without_stop_words_on_an_empty_page():
    polish = "Dom nad rzeką zbudowano podczas wielkiej powodzi, ogród schodzi tam prosto nad wodę, wokół stoi kamienny mur."
    assert extract(f"<body><div><p>{polish}</p></div></body>") == polish


ODD = ["http://[bad\tx/", "http://a.b/x\ty", "about:unknown", "", None, "http://a.b:99999/x", "http://a\nb/", "\x00", "a: b", "http://www.a.b/c?d", "x" * 5000, "http://ü.example/ä", " "]


def test_odd_addresses_are_read_back(spark):
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(ODD)], "page_id long, url string, html string")
    path = warc.write_archive(pages)
    index = warc.build_index(spark, path)
    got = {r["page_id"]: r for r in warc.read_captures(spark, path, index).collect()}
    assert {i: r["payload"] for i, r in got.items()} == {i: f"<p>{i}</p>" for i in range(len(ODD))}
    assert {i: r["url"] for i, r in got.items()} == {i: u if u is None else u.replace("\n", "%0A") for i, u in enumerate(ODD)}
    captures = warc.Captures(spark, index)
    assert [page for *_, page in captures.lines("http://[bad\tx/")] == [0] and [page for *_, page in captures.lines("https://a.b/c?d")] == [9]


def test_files_are_bounded_by_their_longest_record(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BYTES", 60_000)
    pages = spark.createDataFrame([(i, "u", "x" * (20_000 if i == 3 else 10)) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archive(pages)
    sizes = [r["n"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).selectExpr("length AS n").collect()]
    assert len(sizes) == 6 and max(sizes) <= 60_000
