"""KTC pages are JSON-first, HTML cards only without usable embedded JSON."""
from promospark.operators.payloads import ktc_page_promotions

HTML_PAGE = """<html><body>
<div class="promotion-list">
<a class="card" href="/promotion/dining/sushi-deal"><img data-src="/img/s.jpg"><h3>ส่วนลด 20% Sushi</h3></a>
<a href="https://www.ktc.co.th/promotion/travel/hotel-50/"><p>Hotel &amp; Spa 50%</p></a>
<div class="card-item"><h4>Card item deal</h4><a href="/promotion/x/card-item-1">more</a></div>
<a href="/about"><h3>Not a promotion</h3></a>
</div></body></html>"""

JSON_PAGE = ('<html><script id="__NEXT_DATA__" type="application/json">'
             '{"props": {"pageProps": {"promotions": [{"id": "j1", "title": "JSON deal 10%"}]}}}</script>'
             '<a href="/promotion/ignored"><h3>ignored html card</h3></a></html>')

BROKEN_JSON_PAGE = ('<html><script id="__NEXT_DATA__">{not json</script>'
                    '<a href="/promotion/fallback-1"><h2>Fallback card</h2></a></html>')


def test_json_first_then_html_cards(spark):
    pages = spark.createDataFrame([(1, HTML_PAGE), (2, JSON_PAGE), (3, BROKEN_JSON_PAGE)],
                                  "seq BIGINT, html STRING")
    rows = {(r["source_id"], r["title"], r["source_url"], r["merchant_name"], r["image_url"])
            for r in ktc_page_promotions(pages).collect()}
    assert rows == {
        ("sushi-deal", "ส่วนลด 20% Sushi", "https://www.ktc.co.th/promotion/dining/sushi-deal",
         "ส่วนลด 20% Sushi", "https://www.ktc.co.th/img/s.jpg"),
        ("hotel-50", "Hotel & Spa 50%", "https://www.ktc.co.th/promotion/travel/hotel-50/",
         "Hotel & Spa 50%", None),
        ("card-item-1", "Card item deal", "https://www.ktc.co.th/promotion/x/card-item-1",
         "Card item deal", None),
        ("j1", "JSON deal 10%", "https://www.ktc.co.th/promotion/j1", "JSON deal 10%", None),
        ("fallback-1", "Fallback card", "https://www.ktc.co.th/promotion/fallback-1", "Fallback card", None),
    }


NESTED_PAGE = """<body><div class="promotion-card"><div class="img"><img src='/img/a.jpg'></div><h3>Nested &amp; deep</h3>
<div><a href='/promotion/x/nested-1'>more</a></div></div><p>outside</p>
<div class='card-item wide'><div><div></div></div><p>Single <b>quoted</b></p><a href=/about/unquoted>more</a></div>
<a href='/promotion/y/anchor-1'><h4>Anchor one</h4><img data-src="https://i/b.jpg"></a>
<div class=PromoCard><span>no title</span></div><h2>not in a card</h2>
<script>var x = "<div class='promotion'><h3>script</h3></div>"</script></body>"""


def test_cards_by_nesting_and_any_quoting(spark):
    pages = spark.createDataFrame([(1, NESTED_PAGE), (2, None), (3, "<p>none</p>")], "seq BIGINT, html STRING")
    rows = [(r["source_id"], r["title"], r["source_url"], r["image_url"])
            for r in ktc_page_promotions(pages).orderBy("ord").collect()]
    assert rows == [
        ("nested-1", "Nested & deep", "https://www.ktc.co.th/promotion/x/nested-1", "https://www.ktc.co.th/img/a.jpg"),
        ("unquoted", "Single quoted", "https://www.ktc.co.th/about/unquoted", None),
        ("anchor-1", "Anchor one", "https://www.ktc.co.th/promotion/y/anchor-1", "https://i/b.jpg"),
    ]
