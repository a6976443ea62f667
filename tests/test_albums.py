from pyspark.sql import functions as F

from pairmatch.functions import links as fx
from pairmatch.operators import albums as al

LIST = (
    'x item: {"count":2,\n"album_images":{"images":[{"hash":"key","ext":".jpg?1"},'
    '{"hash":"b","ext":".gif"},{"hash":"c","ext":".jpg"}]}} }; item: {"hash":"no"} };'
)
PLAIN = LIST.replace(".jpg?1", ".jpg")
SINGLE = 'item: {"hash":"h","ext":".png?2"} };'


def pages(spark, *html):
    rows = [("key", f"t3_{i}", h) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "main_key string, post_id string, html string")


def listed(df):
    return [(r.post_id, r.position, r.hash, r.ext) for r in df.orderBy("post_id", "position").collect()]


def test_json_images(spark):
    got = listed(al.album_images(pages(spark, LIST, SINGLE, "nothing", 'item: {"x":1} };', "item: {bad };")))
    assert got == [
        ("t3_0", 1, "key", ".jpg"), ("t3_0", 2, "b", ".gif"), ("t3_0", 3, "c", ".jpg"),
        ("t3_1", 1, "h", ".png"),
    ]


def test_regex_images_drop_the_albums_own_key(spark):
    got = listed(al.album_images(pages(spark, PLAIN, LIST, SINGLE), "regex"))
    assert got == [
        ("t3_0", 1, "b", ".gif"), ("t3_0", 2, "c", ".jpg"),
        # an extension with a query is no match: the key takes the next one and is dropped
        ("t3_1", 1, "c", ".jpg"),
    ]


def test_download_plan(spark):
    images = al.album_images(pages(spark, LIST))
    plan = [(r.position, r.image_url, r.file_name) for r in al.download_plan(images).orderBy("position").collect()]
    assert plan == [
        (1, "http://i.imgur.com/key.jpg", "t3_0.jpg"), (3, "http://i.imgur.com/c.jpg", "t3_0.jpg"),
    ]
    first = al.download_plan(images, first_per_ext=True).collect()
    assert [r.position for r in first] == [1]


def test_extension_counts(spark):
    counts = al.extension_counts(al.album_images(pages(spark, LIST, SINGLE)))
    assert [tuple(r) for r in counts.collect()] == [(".jpg", 2), (".gif", 1), (".png", 1)]


def test_every_page_gives_images_or_a_reason(spark):
    pages = [
        (1, None, "no text"), (2, "", "no item"), (3, "<p>item: nothing", "no item"), (4, 'item: {"hash": };', "item doesn't parse"),
        (5, 'item: {"album_images":{"images":[]}} };', "no images"), (6, "item: {} };", "no images"),
        (7, 'item: {"hash":"h","ext":".jpg"} };', None), (8, 'item: {"album_images":{"images":[{"hash":"a","ext":".png"}]}} };', None),
    ]
    table = spark.createDataFrame([(i, f"k{i}", html) for i, html, _ in pages], "page_id int, main_key string, html string")
    failures = {r.page_id: r.reason for r in al.album_failures(table).collect()}
    assert failures == {i: reason for i, _, reason in pages if reason}
    found = {r.page_id for r in al.album_images(table).collect()}
    assert found == {7, 8}
    by_pattern = {r.page_id for r in al.album_failures(table, "regex").collect()}
    assert by_pattern | {r.page_id for r in al.album_images(table, "regex").collect()} == {i for i, _, _ in pages}


def test_link_plan(spark):
    links = spark.createDataFrame(
        [
            ("image", "http://x.org/a.png", "n", "t3_1"),
            ("image", "http://x.org/b.png", None, "t3_2"),
            ("imgur_album", "http://imgur.com/r/pics/k.png", "n", "t3_3"),
            ("imgur_album", "http://imgur.com/r/k.png?1", "n", "t3_4"),
            ("imgur_album", "http://imgur.com/a/k.gif", "n", "t3_5"),
            ("imgur_album", "http://imgur.com/a/k", "n", "t3_6"),
            ("imgur_album", "http://other.org/imgur/a/k", "n", "t3_7"),
            ("imgur_album", None, "n", "t3_8"),
        ],
        "link_type string, link string, name string, post_id string",
    )
    plan = {r.file_name: r.image_url for r in al.link_plan(links).collect()}
    assert plan == {
        "n_t3_1.jpg": "http://x.org/a.png",
        "t3_2.jpg": "http://x.org/b.png",
        "n_t3_3.png": "http://i.imgur.com/pics.png",
        "n_t3_4.png": "http://i.imgur.com/k.png",
    }
    second = al.link_plan(links, subreddit_key=True).where("post_id = 't3_3'").first()
    assert second.image_url == "http://i.imgur.com/k.png"
    pages = al.links_with_pages(links).collect()
    assert [tuple(r) for r in pages] == [("http://imgur.com/a/k", "k", "http://imgur.com/a/k/all", "n_t3_6")]
    reasons = {r.link: r.reason for r in al.link_failures(links).collect()}
    assert reasons == {
        "http://imgur.com/a/k.gif": "gif", "http://other.org/imgur/a/k": "not an album link", None: "not an album link",
    }
    assert al.link_plan(links.limit(0)).count() == 0


def test_album_file_title(spark):
    rows = spark.createDataFrame(
        [(1, "<title> Café: x - Album on Imgur</title>", "k", None), (2, "<title>T - Imgur</title>", "k", "a/b?"),
         (3, "none", "k", ""), (4, None, "k", None)],
        "i int, html string, key string, given string",
    )
    got = rows.select("i", fx.album_file_title(F.col("html"), F.col("key"), F.col("given")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {1: "Cafe x (k)", 2: "ab", 3: "k", 4: "k"}
