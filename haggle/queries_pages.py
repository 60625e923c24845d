"""Queries that extract products from result pages.  The pages are written from ``part``, so the SQL says
from the table what every extractor must find, drop and complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haggle.extract import frames
from haggle.operators import summary
from haggle.plans.merge import merge_pages, saved_rows
from haggle.plans.shop_pages import ITEMS_SQL, asked, pages
from haggle.registered import query

#: The place of a found row in its page, by the item it comes from.
ORD = "row_number() OVER (PARTITION BY page_id ORDER BY n)::BIGINT - 1 AS ord"


def found(pages_asked: DataFrame, *columns: str) -> DataFrame:
    """Candidates of the pages in the order of extraction."""
    rows = frames.parse_pages(pages_asked).select("page_id", F.posexplode("candidates").alias("ord", "c"))
    return rows.select("page_id", F.col("ord").cast("bigint").alias("ord"), *(F.col(f"c.{c}") for c in columns), F.col("c.raw").alias("raw"))


def facts(rows: DataFrame, **kinds: str) -> DataFrame:
    """A site's raw facts as columns."""
    return rows.select(*(c for c in rows.columns if c != "raw"), *(F.get_json_object("raw", f"$.{k}").cast(kind).alias(k) for k, kind in kinds.items()))


# -- any page ------------------------------------------------------------------------------------------


@query(
    f"""WITH {ITEMS_SQL}
    SELECT page_id, {ORD}, CASE n % 5 WHEN 2 THEN n::VARCHAR ELSE p_name END AS product_name,
      CASE n % 5 WHEN 0 THEN amount WHEN 1 THEN p_size * 100 WHEN 2 THEN p_size END::BIGINT AS price,
      CASE n % 5 WHEN 0 THEN won || '원' WHEN 1 THEN (p_size * 100)::VARCHAR WHEN 2 THEN p_size || '.75' ELSE '문의' END AS price_text,
      CASE n % 5 WHEN 0 THEN 'USD' ELSE 'KRW' END AS currency, CASE n % 5 WHEN 2 THEN 'plain' WHEN 3 THEN NULL ELSE p_brand END AS seller,
      CASE n % 5 WHEN 0 THEN '/products/' || n WHEN 2 THEN '/items/' || n END AS product_url,
      CASE n % 5 WHEN 0 THEN '/i/' || n || '.jpg' WHEN 1 THEN '/b/' || n || '.jpg' END AS image_url, CASE n % 5 WHEN 0 THEN p_type END AS description
    FROM items WHERE n % 5 < 4"""
)
def json_ld_products(spark, sf):
    item = """CASE n % 5
      WHEN 0 THEN concat('{"@type":"Product","name":"', p_name, '","offers":{"price":"', won, '원","priceCurrency":"USD","url":"/products/', n, '","seller":{"name":"', p_brand,
        '"}},"image":["/i/', n, '.jpg","/x.jpg"],"description":"', p_type, '"}')
      WHEN 1 THEN concat('{"@type":["Thing","Product"],"name":"', p_name, '","offers":[{"price":0,"lowPrice":', p_size * 100, '}],"brand":{"name":"', p_brand, '"},"image":{"url":"/b/', n, '.jpg"}}')
      WHEN 2 THEN concat('{"type":"product","name":', n, ',"price":', p_size, '.75,"url":"/items/', n, '","seller":"plain"}')
      WHEN 3 THEN concat('{"@type":"Person","name":"', p_brand, '","@graph":[{"@type":"PRODUCT","name":"', p_name, '","price":"문의"},{"@type":"Offer"}]}')
      ELSE '{"@type":"Offer","name":"no product"}' END"""
    made = pages(
        spark, sf, item, '<script type="application/ld+json">{broken</script><script type="Application/LD+JSON">[', ']</script><a href="/about">about</a>', ","
    )
    return found(asked(made), "product_name", "price", "price_text", "currency", "seller", "product_url", "image_url", "description").drop("raw")


@query(
    f"""WITH {ITEMS_SQL}, f AS (
      SELECT page_id, n, p_name AS product_name, CASE n % 4 WHEN 0 THEN amount WHEN 1 THEN p_size END::BIGINT AS price,
        CASE n % 4 WHEN 0 THEN won || '원' WHEN 1 THEN p_size || '.9' ELSE '가격 제안' END AS price_text, CASE n % 4 WHEN 0 THEN p_brand WHEN 3 THEN p_type END AS seller,
        CASE n % 4 WHEN 1 THEN '/item/' || n WHEN 3 THEN '/u/' || n END AS product_url, CASE n % 4 WHEN 0 THEN '/s/' || n || '.jpg' WHEN 1 THEN '/t/' || n || '.jpg' END AS image_url,
        CASE n % 4 WHEN 0 THEN p_type END AS description FROM items WHERE n % 4 <> 2
      UNION ALL SELECT DISTINCT page_id, -1, 'Shop', NULL::BIGINT, NULL, NULL, '/home', NULL, NULL FROM items)
    SELECT {ORD}, * EXCLUDE n FROM f"""
)
def embedded_products(spark, sf):
    item = """CASE n % 4
      WHEN 0 THEN concat('{"productName":"', p_name, '","price":"', won, '원","seller":{"nickname":"', p_brand, '"},"image":{"src":"/s/', n, '.jpg"},"desc":"', p_type, '"}')
      WHEN 1 THEN concat('{"name":"","title":"', p_name, '","salePrice":', p_size, '.9,"link":"/item/', n, '","thumbnail":["/t/', n, '.jpg"]}')
      WHEN 2 THEN '{"name":"only a name"}'
      ELSE concat('{"itemName":"', p_name, '","amount":"가격 제안","itemUrl":"/u/', n, '","storeName":"', p_type, '","content":null}') END"""
    made = pages(
        spark, sf, item, '<script>window.__S__ = {"title":"Shop","url":"/home","list":[', ']};</script><script>var y = {"name":"a","price":1}</script>', ","
    )
    return found(asked(made), "product_name", "price", "price_text", "seller", "product_url", "image_url", "description").drop("raw")


@query(
    f"""WITH {ITEMS_SQL}, f AS (
      SELECT page_id, n, CASE n % 4 WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS pass, CASE n % 4 WHEN 3 THEN p_name || ' ' || p_type ELSE p_name END AS product_name,
        won || CASE n % 4 WHEN 3 THEN ' 원' ELSE '원' END AS price_text, CASE n % 4 WHEN 0 THEN '/product/' WHEN 1 THEN '/item/' ELSE '/goods/' END || n AS product_url,
        CASE n % 4 WHEN 1 THEN '/d/' || n || '.jpg' WHEN 3 THEN '/g/' || n || '.jpg' END AS image_url,
        CASE n % 4 WHEN 3 THEN '그림 / ' || p_name || ' ' || p_type ELSE p_name END AS description, CASE n % 4 WHEN 0 THEN 6.0 ELSE 7.0 END::DOUBLE AS confidence
      FROM items WHERE n % 4 <> 2)
    SELECT row_number() OVER (PARTITION BY page_id ORDER BY pass, n)::BIGINT - 1 AS ord, * EXCLUDE (n, pass) FROM f"""
)
def dom_candidates(spark, sf):
    # A text with its price in a link; a list item with the price outside the link; no product link; an item card.
    item = """CASE n % 4
      WHEN 0 THEN concat('<p><a href="/product/', n, '">', p_name, ' ', won, '원 now</a></p>')
      WHEN 1 THEN concat('<li><a href="/item/', n, '"><img src="data:x" data-src="/d/', n, '.jpg" alt="', p_name, '"></a><b>', won, '원</b></li>')
      WHEN 2 THEN concat('<a href="/about/', n, '">', p_name, ' ', won, '원</a>')
      ELSE concat('<li id="productItem', n, '"><a href="/goods/', n, '"><img src="/g/', n, '.jpg" alt="그림"></a><p class="prod_name"><a href="/goods/', n, '">', p_name, ' <b>', p_type,
        '</b></a></p><strong>', won, '</strong>원</li>') END"""
    return found(asked(pages(spark, sf, item)), "product_name", "price_text", "product_url", "image_url", "description", "confidence").drop("raw")


@query(
    f"""WITH {ITEMS_SQL}, k AS (SELECT n AS page_id, n % 4 AS kind, p_name FROM items),
    f AS (
      SELECT page_id, kind, i AS ord, CASE WHEN kind = 0 THEN 'ld ' || i WHEN kind = 1 THEN ['json ' || page_id, p_name][i + 1] WHEN kind = 2 THEN p_name ELSE 'ld 0' END AS product_name
      FROM k, unnest(range(CASE kind WHEN 0 THEN 8 WHEN 1 THEN 2 ELSE 1 END)) u(i))
    SELECT page_id, ord::BIGINT AS ord, product_name, CASE WHEN kind = 2 THEN 10.0 WHEN kind = 1 AND ord = 1 THEN 6.0 ELSE 0.0 END::DOUBLE AS confidence FROM f"""
)
def extractor_order(spark, sf):
    """A site's own extractor alone, else JSON-LD, embedded JSON and blocks until the page's cap."""
    from haggle.plans.shop_pages import items

    ld = lambda n: '<script type="application/ld+json">[' + ",".join(f'{{"@type":"Product","name":"ld {i}"}}' for i in range(n)) + "]</script>"
    link = "concat('<a href=\"/product/', n, '\">', p_name, ' ', won, '원</a>')"
    card = "concat('<a href=\"/goods/', n, '\"><img src=\"/a.jpg\" alt=\"', p_name, '\"><em class=\"sales-price\">', won, '원</em></a>')"
    html = f"""CASE n % 4 WHEN 0 THEN concat('{ld(9)}', {link})
      WHEN 1 THEN concat('<script>{{"name":"json ', n, '","price":5}}</script>', {link})
      WHEN 2 THEN concat('{ld(1)}', {card})
      ELSE '{ld(1)}' END"""
    made = items(spark, sf).select(F.col("n").alias("page_id"), F.expr(html).alias("html"), F.when(F.col("n") % 4 >= 2, "kurly").alias("source"))
    return found(asked(made, F.col("source"), limit=1), "product_name", "confidence").drop("raw")


# -- sites ---------------------------------------------------------------------------------------------


@query(
    f"""WITH {ITEMS_SQL}
    SELECT page_id, {ORD}, p_name AS product_name, amount AS price, amount::VARCHAR AS price_text,
      'https://www.kurly.com/goods/' || n || CASE n % 4 WHEN 0 THEN '?x=1' ELSE '' END AS product_url, 'https://www.kurly.com/a/' || n || '.jpg' AS image_url,
      CASE n % 4 WHEN 0 THEN 'fine ' || p_type ELSE p_type END AS description, 'new' AS condition, 10.0::DOUBLE AS confidence, n::VARCHAR AS product_id,
      CASE n % 4 WHEN 0 THEN amount * 2 END AS original_price, CASE n % 4 WHEN 0 THEN p_size END::BIGINT AS discount_rate, CASE n % 4 WHEN 0 THEN 999 END::BIGINT AS review_count
    FROM items WHERE n % 4 IN (0, 3)"""
)
def kurly_cards(spark, sf):
    # Whole cards, a second link of the same number, sold-out cards, cards with little in them.
    whole = """concat('<a href="/goods/', n, '?x=1"><img class="sticker" src="https://img/sticker.png"><img src="/a/', n, '.jpg" alt="', p_name, '"><span class="product-name">', p_name,
      '</span><p class="product-desc">fine ', p_type, '</p><span class="dimmed-price">', format_number(amount * 2, 0), '원</span><i class="discount-rate">', p_size, '%</i><span class="sales-price">',
      {cost}, '</span><span class="review-count">999+</span></a>')"""
    item = f"""CASE n % 4 WHEN 0 THEN {whole.format(cost="concat(won, '원')")} WHEN 1 THEN concat('<a href="/goods/', n - 1, '">again</a>') WHEN 2 THEN {whole.format(cost="'품절'")}
      ELSE concat('<a href="https://www.kurly.com/goods/', n, '"><img src="/a/', n, '.jpg" alt="', p_name, '"><b>', p_name, '</b><i>', p_type, '</i><em class="discount-price">', won, '원</em></a>') END"""
    rows = found(asked(pages(spark, sf, item), "kurly"), "product_name", "price", "price_text", "product_url", "image_url", "description", "condition", "confidence")
    return facts(rows, product_id="string", original_price="bigint", discount_rate="bigint", review_count="bigint")


@query(
    f"""WITH {ITEMS_SQL}
    SELECT page_id, {ORD}, p_name AS product_name, amount AS price,
      CASE n % 3 WHEN 0 THEN format('{{:,}}', amount * 2) || ' 정상가 2% 할인율 ' || won || ' 최종가' ELSE won || '원' END AS price_text, CASE n % 3 WHEN 1 THEN p_brand END AS seller,
      'https://www.lotteon.com/p/product/' || CASE n % 3 WHEN 0 THEN 'LO' ELSE 'lo' END || n AS product_url,
      'https://contents.lotteon.com/itemimage/' || n || CASE n % 3 WHEN 0 THEN '.jpg' ELSE '.png' END AS image_url, CASE n % 3 WHEN 0 THEN 'LO' || n || '_1' END AS sitm_no,
      CASE n % 3 WHEN 0 THEN amount * 2 END AS original_price, CASE n % 3 WHEN 0 THEN 2 END::BIGINT AS discount_rate, CASE n % 3 WHEN 0 THEN 4.5 END::DOUBLE AS rating,
      CASE n % 3 WHEN 0 THEN 1203 END::BIGINT AS review_count, CASE n % 3 WHEN 1 THEN p_brand END AS brand
    FROM items WHERE n % 3 < 2"""
)
def lotteon_cards(spark, sf):
    item = """CASE n % 3
      WHEN 0 THEN concat('<li class="c-product-list__item"><a href="/p/product/LO', n, '?sitmNo=LO', n, '_1&mall_no=1"><img src="//contents.lotteon.com/itemimage/', n,
        '.jpg"></a><div class="c-product-title">', p_name, '</div><div class="c-product-price"><s class="c-product-price__real">', format_number(amount * 2, 0),
        ' 정상가</s><i class="c-product-price__sale">2% 할인율</i><b class="c-product-price__final">', won, ' 최종가</b></div><p>4.5 고객평점 1,203 리뷰</p></li>')
      WHEN 1 THEN concat('<li class="x c-product-list__item"><a href="https://www.lotteon.com/p/product/lo', n, '">', p_name, '</a><img data-src="https://contents.lotteon.com/itemimage/', n,
        '.png"><div class="c-product-price">', won, '원</div><em class="brand-name">', p_brand, '</em></li>')
      ELSE concat('<li class="c-product-list__item"><a href="/p/product/XX', n, '">', p_name, '</a></li>') END"""
    rows = found(asked(pages(spark, sf, item), "lotteon"), "product_name", "price", "price_text", "seller", "product_url", "image_url")
    return facts(rows, sitm_no="string", original_price="bigint", discount_rate="bigint", rating="double", review_count="bigint", brand="string")


@query(
    f"""WITH {ITEMS_SQL}
    SELECT page_id, {ORD}, p_name AS product_name, amount AS price, amount::VARCHAR AS price_text, CASE n % 3 WHEN 0 THEN p_brand END AS seller,
      'https://product.29cm.co.kr/catalog/' || n AS product_url, 'https://img.29cm.co.kr/item/' || n || CASE n % 3 WHEN 0 THEN '.jpg' ELSE '.png' END AS image_url,
      CASE n % 3 WHEN 1 THEN p_size END::BIGINT AS discount_rate
    FROM items WHERE n % 3 < 2"""
)
def cm29_cards(spark, sf):
    item = """CASE n % 3
      WHEN 0 THEN concat('<li><a href="https://product.29cm.co.kr/catalog/', n, '?k=1"><img src="https://img.29cm.co.kr/cms/banner.jpg"><img src="https://img.29cm.co.kr/item/', n, '.jpg" alt="', p_name,
        '"></a><div class="brand">', p_brand, '</div><div class="name">', p_name, '</div><div>', won, '</div><div>5 리뷰 999 좋아요 123</div></li>')
      WHEN 1 THEN concat('<li><a href="/catalog/', n, '"><img data-src="//img.29cm.co.kr/item/', n, '.png" title="', p_name, '"></a><p>', p_size, '% ', won, '</p></li>')
      ELSE concat('<li><a href="/catalog/', n, '"><img src="https://img.29cm.co.kr/cms/', n, '.jpg" alt="', p_name, '"></a><p>', won, '</p></li>') END"""
    rows = found(asked(pages(spark, sf, item), "29cm"), "product_name", "price", "price_text", "seller", "product_url", "image_url")
    return facts(rows, discount_rate="bigint")


@query(
    f"""WITH {ITEMS_SQL}, f AS (
      SELECT page_id, n, p_name AS product_name, CASE n % 3 WHEN 0 THEN amount ELSE p_size * 100 END AS price, CASE n % 3 WHEN 0 THEN p_brand END AS seller,
        'https://www.11st.co.kr/products/' || n AS product_url, CASE n % 3 WHEN 0 THEN 'https://cdn.11st.co.kr/' ELSE 'http://i/' END || n || '.jpg' AS image_url, n::VARCHAR AS product_id
      FROM items WHERE n % 3 < 2
      UNION ALL SELECT DISTINCT page_id, 1000000000000, 'ad', 5, NULL, 'https://www.11st.co.kr/ad', 'https://www.11st.co.kr/ad.jpg', 'ad' FROM items)
    SELECT page_id, {ORD}, product_name, price::BIGINT AS price, price::VARCHAR AS price_text, seller, product_url, image_url, product_id FROM f"""
)
def elevenst_items(spark, sf):
    # The array of the most points comes first, though the advertised one stands before it.
    item = """CASE n % 3
      WHEN 0 THEN concat('{"id":"', n, '","title":"', p_name, '","finalPrc":"', won, '","selPrc":"9","linkUrl":"//www.11st.co.kr/products/', n, '","imageUrl":"//cdn.11st.co.kr/', n, '.jpg","sellerName":"', p_brand, '"}')
      WHEN 1 THEN concat('{"productNo":"', n, '","productName":"', p_name, '","price":', p_size * 100, ',"link":"/products/', n, '","thumb":"http://i/', n, '.jpg"}')
      ELSE concat('{"id":"', n, '","title":"', p_name, '"}') END"""
    ads = '{"ads":[{"id":"ad","title":"ad","price":5,"linkUrl":"/ad","imageUrl":"/ad.jpg"}],"data":{"items":['
    bare = pages(spark, sf, item, ads, "]}}", ",")
    # Rendered by a browser, the answer stands in a pre element.
    made = bare.withColumn("html", F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("<html><body><pre>"), "html", F.lit("</pre></body></html>"))).otherwise(F.col("html")))
    return facts(found(asked(made, "elevenst"), "product_name", "price", "price_text", "seller", "product_url", "image_url"), product_id="string")


@query(
    f"""WITH {ITEMS_SQL}
    SELECT page_id // 2 AS page_id, row_number() OVER (PARTITION BY page_id // 2 ORDER BY n)::BIGINT - 1 AS ord, p_name AS product_name, amount AS price, 'https://www.11st.co.kr/products/' || n AS product_url
    FROM items WHERE page_id % 10 <> 3"""
)
def elevenst_two_pages(spark, sf):
    """The two answers of a search as one page; an answer that is no JSON gives nothing."""
    from haggle.sources.fetch import joined_answers

    item = """concat('{"id":"', n, '","title":"', p_name, '","finalPrc":"', won, '","linkUrl":"/products/', n, '","imageUrl":"/i/', n, '.jpg"}')"""
    answers = pages(spark, sf, item, '{"items":[', "]}", ",")
    broken = F.when(F.col("page_id") % 10 == 3, "<html>").otherwise(F.col("html"))
    numbered = answers.select(F.floor(F.col("page_id") / 2).alias("search"), (F.col("page_id") % 2 + 1).alias("page_no"), F.concat(F.lit('https://"/'), "page_id").alias("url"), broken.alias("html"))
    made = joined_answers(numbered, ["search"]).withColumnRenamed("search", "page_id")
    return found(asked(made, "elevenst"), "product_name", "price", "product_url").drop("raw")


@query(
    f"""WITH {ITEMS_SQL}
    SELECT page_id, {ORD}, p_name AS product_name, amount AS price, amount::VARCHAR AS price_text, p_brand AS seller, 'https://www.musinsa.com/products/' || n AS product_url,
      'https://i/' || n || '.jpg' AS image_url, n AS "goodsNo"
    FROM items WHERE n % 4 < 2"""
)
def musinsa_items(spark, sf):
    item = """concat('{"goodsNo":', n, ',"goodsName":"', p_name, '","goodsLinkUrl":"https://www.musinsa.com/products/', n, '",', CASE n % 4
      WHEN 0 THEN concat('"thumbnail":"https://i/', n, '.jpg","finalPrice":', amount, ',"price":7,"brandName":"', p_brand, '"')
      WHEN 1 THEN concat('"thumbnail":"https://i/', n, '.jpg","finalPrice":0,"couponPrice":"', won, '","brandName":" ","brand":" ', p_brand, ' "')
      WHEN 2 THEN concat('"thumbnail":"https://i/', n, '.jpg","finalPrice":-5,"price":true,"normalPrice":"call"')
      ELSE concat('"finalPrice":', amount) END, '}')"""
    before = '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"dehydratedState":{"queries":[{},{"state":{"data":{"pages":[{"items":['
    rows = found(asked(pages(spark, sf, item, before, "]}]}}}]}}}}</script>", ","), "musinsa"), "product_name", "price", "price_text", "seller", "product_url", "image_url")
    return facts(rows, goodsNo="bigint")


# -- saved pages ---------------------------------------------------------------------------------------

SHOP = "https://search.shopping.naver.com"
SAVED_SQL = f"""
  {ITEMS_SQL},
  saved AS (
    SELECT page_id, n, p_name || CASE n % 5 WHEN 4 THEN ' ' || (n - 1) ELSE ' ' || n END AS product_name, CASE n % 5 WHEN 1 THEN 'ad' ELSE 'organic' END AS product_type,
      amount::DOUBLE AS price, CASE n % 5 WHEN 0 THEN amount * 2 END::DOUBLE AS original_price, CASE n % 5 WHEN 0 THEN 0 WHEN 1 THEN 3000 END::DOUBLE AS shipping_fee,
      CASE n % 5 WHEN 2 THEN 'Low' WHEN 3 THEN NULL ELSE p_brand END AS seller, CASE WHEN n % 5 <> 3 THEN '{SHOP}/m/' || (n % 37) || '?utm_source=x' END AS product_url,
      '{SHOP}/i/' || n || '.jpg' AS image_url, '{SHOP}/search/all?query=red%20ring' AS source_url
    FROM items),
  named AS (SELECT *, row_number() OVER (PARTITION BY page_id, product_name ORDER BY n) AS twin FROM saved),
  kept AS (SELECT *, 'page-' || lpad(page_id::VARCHAR, 9, '0') AS source_file, row_number() OVER (PARTITION BY page_id ORDER BY n)::BIGINT - 1 AS item_ord FROM named WHERE twin = 1)
"""
SAVED_SHOWN = "source_file, item_ord, product_name, product_type, price, original_price, shipping_fee, seller, product_url, image_url, source_url"


def _saved(spark, sf):
    """Saved result pages: page state, and cards of the advertised ones."""
    # The fifth item of each five repeats the name of the fourth where their names are alike.
    item = """concat('{"item":{"productTitle":"', p_name, ' ', CASE n % 5 WHEN 4 THEN n - 1 ELSE n END, '","imageUrl":"/i/', n, '.jpg","price":"', won, '"', CASE n % 5
      WHEN 0 THEN concat(',"listPrice":', amount * 2, ',"dlvryFee":"0","mallName":"', p_brand, '"')
      WHEN 1 THEN concat(',"dlvryFee":"3,000원","mallName":" ', p_brand, ' "')
      WHEN 2 THEN ',"mallName":"","lowMallList":[{"name":""},{"name":" Low "}]'
      WHEN 3 THEN '' ELSE concat(',"mallName":"', p_brand, '"') END, CASE WHEN n % 5 <> 3 THEN concat(',"mallProductUrl":" ","crUrl":"/m/', n % 37, '?utm_source=x"') ELSE '' END, '}}')"""
    before = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"searchParam":{"query":"red ring"},"list":['
    state = pages(spark, sf, item, before, "]}}}</script>", ",")
    cards = pages(
        spark, sf,
        """CASE WHEN n % 5 = 1 THEN concat('<div class="adProduct_item__T7utB"><a class="adProduct_link__hNwpz" href="/ad/', n, '">', p_name, ' ', n, '</a></div>') ELSE '' END""",
    ).withColumnRenamed("html", "cards")
    path = F.concat(F.lit("page-"), F.lpad(F.col("page_id").cast("string"), 9, "0"))
    return state.join(cards, "page_id").select(path.alias("path"), F.concat("cards", "html").alias("html"))


@query(f"WITH {SAVED_SQL} SELECT {SAVED_SHOWN}, 'red ring' AS source_query FROM kept")
def saved_products(spark, sf):
    rows, _ = saved_rows(_saved(spark, sf))
    return rows.select(*SAVED_SHOWN.split(", "), "source_query")


@query(
    f"""WITH {SAVED_SQL}
    SELECT source_file, (SELECT count(*) FROM saved s WHERE s.page_id = kept.page_id)::BIGINT AS total_before_dedup, count(*)::INT AS total_after_dedup,
      count(*) FILTER (product_type = 'ad')::INT AS ad_count, count(*) FILTER (product_type = 'organic')::INT AS organic_count,
      (SELECT count(*) FROM saved s WHERE s.page_id = kept.page_id)::BIGINT - count(*) AS duplicate_count
    FROM kept GROUP BY source_file, page_id"""
)
def saved_page_summary(spark, sf):
    return saved_rows(_saved(spark, sf))[1]


MERGED_SQL = f"""
  {SAVED_SQL},
  keyed AS (
    SELECT *, CASE WHEN product_url IS NOT NULL THEN split_part(product_url, '?', 1) ELSE source_file || '::' || lower(product_name) END AS key FROM kept),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_file, item_ord) AS r FROM keyed)
"""


@query(f"WITH {MERGED_SQL} SELECT {SAVED_SHOWN} FROM ranked WHERE r = 1")
def merge_products(spark, sf):
    return merge_pages(_saved(spark, sf))[0].select(*SAVED_SHOWN.split(", "))


_MISSING_SQL = ", ".join(f"count(*) FILTER ({c} IS NULL OR {c}::VARCHAR = '')::BIGINT AS missing_{c}" for c in summary.MISSING)


@query(
    f"""WITH {MERGED_SQL} SELECT source_file, count(*)::BIGINT AS extracted_count, count(*) FILTER (product_type = 'ad')::BIGINT AS ad_count,
      count(*) FILTER (product_type <> 'ad')::BIGINT AS organic_count, {_MISSING_SQL} FROM ranked GROUP BY source_file"""
)
def merge_files(spark, sf):
    return merge_pages(_saved(spark, sf))[1]


@query(
    f"""WITH {MERGED_SQL} SELECT (SELECT count(*) FROM ranked)::BIGINT AS total_extracted_count, (SELECT count(*) FROM ranked WHERE r > 1)::BIGINT AS duplicate_count,
      count(*)::BIGINT AS final_product_count, count(*) FILTER (product_type = 'ad')::BIGINT AS ad_count, count(*) FILTER (product_type = 'organic')::BIGINT AS organic_count, {_MISSING_SQL},
      (SELECT count(DISTINCT page_id) FROM ranked)::BIGINT AS file_count
    FROM ranked WHERE r = 1"""
)
def merge_overall(spark, sf):
    return merge_pages(_saved(spark, sf))[2]


@query(
    f"""WITH {ITEMS_SQL}
    SELECT page_id, {ORD}, p_name || ' ' || n AS product_name, 'ad' AS product_type, CASE n % 3 WHEN 1 THEN p_size * 100 ELSE amount END::DOUBLE AS price,
      CASE n % 3 WHEN 0 THEN amount * 2 WHEN 1 THEN 9 END::DOUBLE AS original_price, CASE n % 3 WHEN 0 THEN 0 WHEN 1 THEN 2500 ELSE 3000 END::DOUBLE AS shipping_fee,
      CASE n % 3 WHEN 1 THEN 'State mall' ELSE p_brand END AS seller, 'https://shop.example.com/ad/' || n AS product_url,
      CASE n % 3 WHEN 1 THEN 'https://shop.example.com/i/' || n || '.jpg' END AS image_url, 'https://shop.example.com/list' AS source_url
    FROM items WHERE n % 7 <> 6"""
)
def saved_ads(spark, sf):
    # Whole cards; cards that the page state completes; every seventh has no link and is no product.
    item = """concat('<div class="adProduct_item__T7utB"><a class="adProduct_link__hNwpz"', CASE WHEN n % 7 <> 6 THEN concat(' href="/ad/', n, '"') ELSE '' END, '>', p_name, ' ', n, '</a>', CASE n % 3
      WHEN 0 THEN concat('<b class="price_num__Y66T7">', won, '원</b><s class="price_org_price__2W2CX">', format_number(amount * 2, 0), '</s><i class="price_delivery_fee__8n1e5">무료배송</i><u class="adProduct_mall__grJaU">', p_brand, '</u>')
      WHEN 1 THEN concat('<b class="price_num__Y66T7">0원</b><script id="x', n, '"></script>')
      ELSE concat('<b class="price_num__Y66T7">', won, '</b><i class="price_delivery_fee__8n1e5">배송비 3,000원</i><u class="adProduct_mall__grJaU">', p_brand, '</u>') END, '</div>')"""
    state = """CASE WHEN n % 3 = 1 THEN concat('{"productName":"', p_name, ' ', n, '","imageUrl":"/i/', n, '.jpg","price":', p_size * 100, ',"listPrice":"9","dlvryFee":2500,"mallName":"State mall"}') ELSE '{}' END"""
    cards = pages(spark, sf, item)
    states = pages(spark, sf, state, '<script id="__NEXT_DATA__">{"all":[', "]}</script>", ",").withColumnRenamed("html", "state")
    made = cards.join(states, "page_id").select("page_id", F.concat("html", "state").alias("html"), F.lit("https://shop.example.com/list").alias("source_url"))
    rows = frames.saved_ads(made).select("page_id", F.posexplode("products").alias("ord", "p"))
    return rows.select("page_id", F.col("ord").cast("bigint").alias("ord"), "p.*")


SECONDHAND_SQL = f"""
  {ITEMS_SQL},
  used AS (
    SELECT page_id, {ORD}, n::VARCHAR AS product_id, p_name AS product_name, amount AS price, 'https://web.joongna.com/product/' || n AS product_url,
      CASE WHEN n % 8 = 0 THEN '/i/' || n || '.jpg' END AS image_url, CASE WHEN n % 8 = 0 THEN '판매중' END AS sale_status FROM items WHERE n % 4 = 0)
"""


def _secondhand(spark, sf):
    item = """CASE n % 4
      WHEN 0 THEN concat('<a href="/product/', n, '">', CASE WHEN n % 8 = 0 THEN concat('<img src="/i/', n, '.jpg"><span>판매중</span>') ELSE '' END, '<span class="line-clamp-2">', p_name,
        '</span><span class="text-18 font-bold">', won, '</span></a>')
      WHEN 1 THEN concat('<a href="/product/', n, '?k=1"><span class="line-clamp-2">other link</span><span class="text-18 font-bold">1</span></a>')
      WHEN 2 THEN concat('<a href="/product/', n, '"><span class="line-clamp-2">no price</span><span class="text-18 font-bold">나눔</span></a>')
      ELSE concat('<a href="/product/', n - 3, '"><span class="line-clamp-2">again</span><span class="text-18 font-bold">1</span></a>') END"""
    rows = frames.secondhand_products(pages(spark, sf, item)).select("page_id", F.posexplode("products").alias("ord", "p"))
    return rows.select("page_id", F.col("ord").cast("bigint").alias("ord"), "p.*")


@query(f"WITH {SECONDHAND_SQL} SELECT * FROM used")
def secondhand(spark, sf):
    return _secondhand(spark, sf)


@query(
    f"""WITH {SECONDHAND_SQL} SELECT page_id::VARCHAR AS source_file, count(*)::BIGINT AS product_count, 0::BIGINT AS missing_name, 0::BIGINT AS missing_price,
      count(*) FILTER (image_url IS NULL)::BIGINT AS missing_image, count(*)::BIGINT AS missing_region, count(*) FILTER (sale_status IS NULL)::BIGINT AS missing_sale_status
    FROM used GROUP BY page_id"""
)
def secondhand_summary(spark, sf):
    return summary.secondhand_summary(_secondhand(spark, sf).withColumn("path", F.col("page_id").cast("string")))


@query(
    f"""WITH {ITEMS_SQL}, h AS (
      SELECT page_id, n, field, selector, place, value FROM items, LATERAL (VALUES
        ('product_name', 'a', 0, p_name), ('product_url', 'a', 1, '/p/' || n), ('image_url', 'img', 2, '/i/' || n || '.jpg'),
        ('price', '.price', 3, won), ('price', 'em.price', 4, won), ('price', 'em', 5, won),
        ('product_name', '.mall-name', 6, p_type), ('product_name', 'span.mall-name', 7, p_type), ('product_name', 'span', 8, p_type),
        ('seller', '.mall-name', 9, p_type), ('seller', 'span.mall-name', 10, p_type), ('seller', 'span', 11, p_type)) v(field, selector, place, value)
      WHERE field <> 'price' OR n % 2 = 0),
    seen AS (SELECT page_id, field, selector, value, min(n) AS first FROM h GROUP BY ALL),
    s AS (
      SELECT page_id, field, selector, string_agg(value, ' | ' ORDER BY first) AS sample_values
      FROM (SELECT *, row_number() OVER (PARTITION BY page_id, field, selector ORDER BY first) AS r FROM seen) WHERE r <= 3 GROUP BY ALL),
    g AS (SELECT page_id, field, selector, count(*)::BIGINT AS match_count, count(DISTINCT n)::BIGINT AS matching_cards, min(n * 100 + place) AS ord FROM h GROUP BY ALL)
    SELECT page_id, field, selector, match_count, matching_cards, sample_values,
      row_number() OVER (PARTITION BY page_id, field ORDER BY matching_cards DESC, match_count DESC, ord)::INT AS rank FROM g JOIN s USING (page_id, field, selector)"""
)
def selector_discovery(spark, sf):
    item = """concat('<section class="card"><a href="/p/', n, '"><b>', p_name, '</b></a><img src="/i/', n, '.jpg">', CASE WHEN n % 2 = 0 THEN concat('<em class="price">', won, '</em>') ELSE '' END,
      '<span class="mall-name">', p_type, '</span></section>')"""
    hits = frames.discovered(pages(spark, sf, item)).select("page_id", F.posexplode("hits").alias("ord", "h")).select("page_id", "ord", "h.*")
    return summary.selector_ranking(hits).withColumn("sample_values", F.array_join("sample_values", " | "))


@query(
    f"""WITH {ITEMS_SQL}, c(place, selector) AS (VALUES (1, '.card'), (2, 'section.card'), (3, 'section'), (4, 'div'))
    SELECT page_id, place::INT AS place, selector, count(*)::BIGINT AS match_count FROM items, c WHERE place < 4 OR n % 20 < 3 GROUP BY ALL"""
)
def card_selectors(spark, sf):
    # Cards have links, pictures and prices; the few plain boxes have prices only.
    item = """concat('<section class="card"><a href="/p/', n, '">', p_name, '</a><img src="/i.jpg"><em>', won, '</em></section>', CASE WHEN n % 20 < 3 THEN '<div>5</div>' ELSE '' END)"""
    rows = frames.discovered(pages(spark, sf, item)).select("page_id", F.posexplode("cards").alias("place", "c"))
    return rows.select("page_id", (F.col("place") + 1).alias("place"), "c.selector", "c.match_count")


@query(
    f"""WITH {ITEMS_SQL} SELECT page_id, count(*)::BIGINT AS found, sum(2 + (n % 3 = 0)::INT)::BIGINT AS total_link_count, count(*) FILTER (n % 3 = 0)::BIGINT AS product_like_link_count,
      2::BIGINT AS script_count, 1::BIGINT AS json_ld_script_count, count(*) FILTER (n % 4 = 0)::BIGINT AS embedded_json_candidate_count,
      count(*) FILTER (n % 3 = 0)::BIGINT AS dom_candidate_count FROM items GROUP BY page_id"""
)
def page_counters(spark, sf):
    """The counters of pages that have something of everything."""
    item = """concat('<a href="/about">a</a><a href="/help">b</a>', CASE WHEN n % 3 = 0 THEN concat('<a href="/product/', n, '">', p_name, ' ', won, '원</a>') ELSE '' END)"""
    links = pages(spark, sf, item)
    data = pages(spark, sf, """CASE WHEN n % 4 = 0 THEN '{"name":"x","price":1}' ELSE '{"name":"y"}' END""", '<script type="application/ld+json">{}</script><script>[', "]</script>", ",").withColumnRenamed("html", "data")
    made = links.join(data, "page_id").select("page_id", F.concat("data", "html").alias("html"))
    from haggle.plans.shop_pages import items

    per = items(spark, sf).groupBy("page_id").agg(F.count("*").alias("found"))
    counted = frames.parse_pages(asked(made)).select("page_id", "stats.*").drop("html_length")
    return counted.join(per, "page_id")
