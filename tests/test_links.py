import pytest
from pyspark.sql import functions as F

from pairmatch.functions import links as fx
from pairmatch.operators import links as ln


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, link string")
    return [r.out for r in df.select("i", expression(F.col("link")).alias("out")).orderBy("i").collect()]


def test_extension_quirks(spark):
    links = ["http://a.b/x.jpg", "http://a.b/x.JPG", "http://a.b/x.jpg?1", "http://site.com", "x.jgp", "xjpg"]
    assert column(spark, links, fx.has_extension) == [True, False, False, True, True, False]
    assert column(spark, links, lambda c: fx.has_extension(c, [".JPG"])) == [False, True, False, False, False, False]


def test_typo_extension_is_left_alone_unless_asked(spark):
    assert column(spark, ["a.jgp", "a.jpg"], fx.fix_typo_extension) == ["a.jgp", "a.jpg"]
    fixed = column(spark, ["a.jgp", "a.jgp.b", "a.com", "a.jpg"], lambda c: fx.fix_typo_extension(c, True))
    assert fixed == ["a.png", "a.jgp.b", "a.png", "a.jpg"]


def test_gif_needs_no_dot(spark):
    assert column(spark, ["xgif", "x.gifv", "x.gif?"], fx.not_gif) == [False, False, True]


def test_rewrite_with_trailing_slash(spark):
    out = column(spark, ["http://imgur.com/abc", "http://imgur.com/abc/", "abc"], fx.rewrite_no_ext_link)
    assert out == ["http://i.imgur.com/abc.jpg", "http://i.imgur.com/.jpg", "http://i.imgur.com/abc.jpg"]


def test_markdown_link(spark):
    bodies = ["[a](b)", "see [a](b)", "[a\rb](c)", "[a\nb](c)", "[](b)", "[x](u_(1).jpg)", "[a) b](c)", None]
    assert column(spark, bodies, fx.has_markdown_link) == [True, False, True, False, False, True, True, None]
    out = column(spark, bodies, fx.extract_markdown_link)
    assert out == ["b", "b", "c", "c", "b", "u_(1", "", None]


def test_parse_album_url(spark):
    links = [
        "http://imgur.com/a/abc#3", "https://i.imgur.com/k5.jpg?1", "http://imgur.com/r/pics/k5",
        "http://m.imgur.com/k5/", "http://example.org/a/x",
    ]
    parsed = column(spark, links, fx.parse_album_url)
    assert [tuple(p) if p else None for p in parsed] == [
        ("http", "a/", "abc", ""), ("https", "", "k5", ".jpg"), ("http", "r/", "pics", ""),
        ("http", "", "k5", ""), None,
    ]
    assert column(spark, links[2:3], lambda c: fx.parse_album_url(c, True))[0].main_key == "k5"


def test_album_all_url(spark):
    links = ["http://imgur.com/a/x", "http://imgur.com/gallery/x/new?q=1#2", "http://imgur.com/x"]
    assert column(spark, links, fx.album_all_url) == [
        "http://imgur.com/a/x/all", "http://imgur.com/a/x/all?q=1#2", "http://imgur.com/x",
    ]


def test_slugify(spark):
    texts = ["  Crème brûlée! (2).jpg ", "ﬁne½ …", "a/b\tc_d-e", None, "ß"]
    assert column(spark, texts, fx.slugify) == ["Creme brulee (2).jpg", "fine12 ...", "ab\tc_d-e", None, ""]


def test_album_title(spark):
    pages = ["<title> My cat - Imgur</title>", "<title>X - Album on Imgur</title>", "none"]
    titles = column(spark, pages, lambda c: fx.album_title(c, F.lit("key")))
    assert titles == ["My cat (key)", "X (key)", "key"]


ROWS = [
    ("http://imgur.com/k1", "a", "p1", 1),
    ("http://i.imgur.com/k1.jpg", "b", "p2", 0),
    ("http://imgur.com/a/al", "a", "p3", 5),
    ("http://imgur.com/a/al", "a", "p4", 4),
    ("http://imgur.com/k.gifv", "a", "p5", 6),
    ("http://i.reddituploads.com/u", "a", "p6", 7),
    ("http://i.reddituploads.com/u.jpg", "a", "p7", 8),
    (None, "a", "p8", 9),
]


def test_classify_links_owner_is_last_of_the_highest_class(spark):
    links = spark.createDataFrame(ROWS, "link string, name string, post_id string, ord long")
    got = {tuple(r) for r in ln.classify_links(links).collect()}
    assert got == {
        # a direct image beats a rewritten link even if it came first
        ("image", "http://i.imgur.com/k1.jpg", "b", "p2"),
        ("imgur_album", "http://imgur.com/a/al", "a", "p3"),
        # the upload class beats the direct image, and the upload image is also one itself
        ("image", "http://i.reddituploads.com/u.jpg", "a", "p6"),
        ("image", "http://i.reddituploads.com/u.jpg.jpg", "a", "p7"),
    }


def test_classify_links_does_not_depend_on_partitions(spark):
    links = spark.createDataFrame(ROWS * 3, "link string, name string, post_id string, ord long")
    one = sorted(ln.classify_links(links.coalesce(1)).collect())
    many = sorted(ln.classify_links(links.repartition(7)).collect())
    assert one == many


def test_subtract_keeps_left_duplicates(spark):
    left = spark.createDataFrame([("a", None), ("a", None), ("b", 1), ("b", 1)], "x string, y int")
    right = spark.createDataFrame([("b", 1)], "x string, y int")
    assert [tuple(r) for r in ln.subtract_rows(left, right).collect()] == [("a", None)] * 2


def test_comment_links(spark):
    comments = spark.createDataFrame(
        [
            ("[x](http://a/1.png)", "t3_1", "t3_1", 1),
            ("[x](http://a/2.png)", "t1_9", "t3_1", 2),
            ("[x](http://a/3.png)", "t3_2", "t3_2", 3),
            (None, "t3_1", "t3_1", 4),
        ],
        "comment_body string, parent_fullname string, post_fullname string, ord long",
    )
    posts = spark.createDataFrame([("t3_1",), ("t3_1",)], "post_id string")
    got = ln.comment_links(comments, posts)
    assert [tuple(r) for r in got.collect()] == [("image", "http://a/1.png", "t3_1")]
    assert ln.comment_file_names(got).first().file_stem == "t3_1_1"


def test_drop_placeholder(spark):
    images = spark.createDataFrame([(1, b"xx"), (2, b"yy"), (3, b"xx")], "i int, content binary")
    known = spark.createDataFrame([(b"xx",)], "content binary")
    assert [r.i for r in ln.drop_placeholder(images, known).collect()] == [2]


def test_block_and_empty_groups(spark):
    links = spark.createDataFrame([(fx.BLOCKED_LINKS[0],), ("x",)], "link string")
    assert [r.link for r in ln.block_links(links).collect()] == ["x"]
    groups = spark.createDataFrame([(1,), (2,)], "g int")
    members = spark.createDataFrame([(2,), (2,)], "g int")
    assert [r.g for r in ln.drop_empty_groups(groups, members, "g").collect()] == [2]


def test_mode_errors(spark):
    from pairmatch.operators.albums import album_images

    pages = spark.createDataFrame([("k", "h")], "main_key string, html string")
    with pytest.raises(ValueError):
        album_images(pages, "other")
