from tidegrid.llm.queries import URL_RULES
from tidegrid.llm.url_filter import filter_urls, rule_table

# Hand-written expectations: url, host, path, rule, verdict.
CASES = [
    ("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://badexample.org/es/1", "badexample.org", "/es/1", "org/", "allow"),
    ("https://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("https://x.com/de/1/2", "x.com", "/de/1/2", "com/de/", "block"),
    ("https://x.com/DE/1", "x.com", "/DE/1", None, "allow"),
    ("https://org", "org", "", None, "allow"),
    ("ftp://u@org:21/a", "u@org:21", "/a", None, "allow"),
    ("https://x.org?/es/", "x.org", "", None, "allow"),
    ("a://b.org//c://d/e#", "b.org", "//c://d/e", "org/", "allow"),
    ("x\ny://é.org/\n", "é.org", "/\n", "org/", "allow"),
    ("no scheme.org/", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_cases_and_repeated_rows(spark):
    rows = [(i // 2, c[0], "x") for i, c in enumerate(CASES + CASES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = filter_urls(pages, rule_table(spark, URL_RULES), keep=("page_id", "url")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r)[1:] for r in got], key=key) == sorted(CASES + CASES, key=key)


def test_longest_rule_then_block_and_null_rules(spark):
    rules = [("allow", "a.org", "/x"), ("block", "a.org", "/x"), ("block", "org", "/"), ("allow", None, "/xyz")]
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.org/xyz"), (2, "http://b.org/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, table).collect()}
    assert got == {1: ("a.org/x", "block"), 2: ("org/", "block")}


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.org/xyz")], "page_id long, url string")
    assert [r.verdict for r in filter_urls(pages, none, default="block").collect()] == ["block"]
    assert filter_urls(pages.limit(0), rule_table(spark, URL_RULES)).count() == 0
