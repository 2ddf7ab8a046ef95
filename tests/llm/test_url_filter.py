import re

from pyspark.sql import functions as F

from docquarry.llm import bloom, url_filter

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
URLS = [
    None, "", "no scheme", "http://", "http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=1", "https://example.org/en/2", "https://notexample.org/es/1", "http://b.com/fr/x", "http://b.com/de/x#y", "http://b.com/De/x", "http://b.com", "http://b.com/",
    "http://c.net/de/1", "https://www.ads-track.example.net/en/5/", "http://ads-track.example.net/en/5.html#top", "http://m.ads-track.example.net/en/5?utm=1", "http://my-ads-track.example.net/en/5", "ftp://x://y/z", "http://h?q/a", "http://h#f/a",
    "http://ads-track.example.org/es/9", "http://free-bets.example.com/fr/9", "http://free-bets.example.com/en/9", "http://a.net/line\nbreak", "http://a.net:80/p", "http://u@A.Net/ü/É",
    "http://www.spam-farm.net/a?x", "https://spam-farm.net/a.html", "https://spam-farm.net/b#?x", "http://spam-farm.net/a.html\n", "http://spam-farm.net/" + "long/" * 40_000 + "?q", "https://m.spam-farm.net/" + "long/" * 40_000,
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in host), path


def canonical(url):
    host, path = split(url)
    return re.sub(r"^(www|m)\.", "", host) + re.sub(r"(\.html|/)\Z", "", path)


def brute(urls):
    listed = {canonical(u) for _, u in urls if u and re.search(r"\A.*?://[^?#]*\?", u, re.S) and set(split(u)[0].split(".")) & set(url_filter.LISTED_SITES)}
    out = []
    for page, url in urls:
        host, path = split(url)
        fits = [r for r in RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        out.append((page, host, path, rule, RULES[rule] if rule else "block" if host and canonical(url) in listed else "allow"))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    pages = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[5]), (None, URLS[14])]
    df = spark.createDataFrame(pages, "page_id long, url string")
    assert sorted((tuple(r) for r in url_filter.filtered(df).collect()), key=repr) == brute(pages)
    clash = df.withColumns({n: F.lit("x") for n in ("host", "path", "rule", "verdict", "canonical", "_host")})
    assert sorted((tuple(r) for r in url_filter.filtered(clash).collect()), key=repr) == brute(pages)
    assert url_filter.filtered(df.where("false")).collect() == []


def test_the_list_does_not_follow_from_the_host(spark):
    pages = spark.createDataFrame(enumerate(URLS), "page_id long, url string")
    verdicts = {r["verdict"] for r in url_filter.filtered(pages).collect() if "spam-farm" in r["host"]}
    assert verdicts == {"allow", "block"}


def test_filter_never_misses_and_seldom_passes(spark):
    listed = spark.range(5000).select(F.concat(F.lit("listed.example/"), "id").alias("canonical"))
    asked = listed.select(F.col("canonical").alias("url")).union(spark.range(20_000).select(F.concat(F.lit("other.example/"), "id"))).union(spark.sql("select cast(null as string)"))
    passed = bloom.marked(asked, F.col("url"), listed).where("_perhaps")
    assert passed.where("url like 'listed%'").count() == 5000
    assert passed.where("url like 'other%'").count() < 400
    assert passed.where("url is null").count() == 0


def test_false_positives_are_removed(spark, monkeypatch):
    monkeypatch.setattr(bloom.marked, "__defaults__", (1, "_perhaps"))
    listed = spark.range(400).select(F.concat(F.lit("l.example/"), "id").alias("canonical"))
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://l.example/"), F.col("id") * 2).alias("url"))
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, listed).collect()}
    assert all(verdicts[i] == ("block" if 2 * i < 400 else "allow") for i in range(400))


def test_pages_that_a_rule_or_the_filter_settles_are_not_shuffled(spark):
    """Most rows without a host, or of one ruled host, meet in no join by key."""
    pages = spark.range(2000).selectExpr("id as page_id", "case when id % 3 = 0 then null when id % 3 = 1 then 'http://a.org/x' else concat('http://b', id, '.net/x') end as url")
    listed = spark.createDataFrame([("b2.net/x",), ("",), ("a.org/x",)], "canonical string")
    out = url_filter.judged(pages, listed)
    assert {r["page_id"] for r in out.where("verdict = 'block'").collect()} == {2}
    assert out.count() == 2000


def test_plan_is_native(spark, small):
    plan = url_filter.filtered(spark.read.parquet(f"{small}/pages.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
