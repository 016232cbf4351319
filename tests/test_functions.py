"""Scalar functions on hand-written values."""

from pyspark.sql import functions as F

from linkloom.functions import anchors, links, urls


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_url_host(spark):
    texts = ["https://www.Shop.com:8080/a", " HTTP://x.org?y\t", "ftp://x", "mailto:a@b", None, "", "https://www.www.a.b/"]
    assert values(spark, texts, urls.url_host) == ["shop.com", "x.org", None, None, None, None, "www.a.b"]


def test_url_path(spark):
    texts = ["https://h:8080//a//b/?q#f", "https://h", "https://h/#top", "not a url", None, " https://h/A/ ", "https://h/a?b/c"]
    assert values(spark, texts, urls.url_path) == [":8080/a/b", "/", "/", "/", "/", "/A", "/a"]


def test_path_parts(spark):
    paths = ["/", "/cars", "/cars/suv", "/a/b/c"]
    assert values(spark, paths, urls.parent_path) == [None, "/", "/cars", "/a/b"]
    assert values(spark, paths, urls.path_depth) == [0, 1, 2, 3]
    assert values(spark, paths, urls.path_section) == ["root", "cars", "cars", "a"]
    assert values(spark, paths, urls.path_cluster) == ["root:__root__", "cars:__root__", "cars:suv", "a:b"]


def test_segment_path(spark):
    paths = ["catalog/brand-a/", "//a//b/?x#y", "", "/", " /a#b?c "]
    assert values(spark, paths, urls.normalize_segment_path) == ["/catalog/brand-a", "/a/b", "/", "/", "/a"]


def test_categories(spark):
    clusters = ["c:voitures", "plain", "a:b:c"]
    assert values(spark, clusters, urls.page_category) == ["voitures", None, "b:c"]
    assert values(spark, clusters, urls.block_category) == ["voitures", "plain", "c"]


def test_link_attributes(spark):
    assert values(spark, ["True", " yes ", "1", "Y", "no", None, ""], links.parse_boolean) == [True] * 4 + [False] * 3
    positions = ["Content", " Navigation ", "Side-Bar (2)", None, "--"]
    assert values(spark, positions, links.normalize_block_type) == ["content", "navigation", "side_bar_2", "unknown", "unknown"]
    weights = values(spark, ["content", "navigation", "footer", "head", "x"], links.block_rule_weight)
    assert [round(w, 6) for w in weights] == [1.0, 0.9, 0.45, 0.25, 0.6]


def test_labels(spark):
    paths = ["/cars/suv", "/u_car:RENAULT-clio/", "/a/b-c/_meta", "_meta", "/", None, "/x/l'été_2"]
    assert values(spark, paths, anchors.label_from_path) == ["Suv", "U Car:Renault Clio", "B C", "Destination", "", "", "L'Été 2"]


def test_anchor_kind(spark):
    rows = [
        ("Découvrir !", "/cars", "generic"),
        ("", "/cars", "generic"),
        ("CARS", "/cars", "exact"),
        ("SUV d'occasion", "/cars/suv", "partial"),
        ("occasion suv", "/cars/suv", "partial"),
        ("ab", "/ab-cd", "contextual"),
        ("Voir voitures", "/cars", "contextual"),
    ]
    df = spark.createDataFrame(rows, "a string, p string, want string")
    got = df.select("want", anchors.infer_anchor_type(F.col("a"), F.col("p")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_token_count_and_selector(spark):
    assert values(spark, ["", "a b", "a  b "], anchors.anchor_token_count) == [1, 2, 4]
    df = spark.createDataFrame([(1, 2, "nav")], "s int, t int, b string")
    drawn = df.select(anchors.scenario_selector(F.col("s"), F.col("t"), F.col("b")).alias("v")).first().v
    assert drawn == 0.6125


def test_templates(spark):
    assert links.expand_templates(["/c/", "homepage", "odd"]) == ["c_L0", "c_L1", "c_L2", "c_L3", "homepage", "odd"]
    assert values(spark, ["/ck/", "odd"], links.alias_templates) == [["ck"], ["odd"]]
