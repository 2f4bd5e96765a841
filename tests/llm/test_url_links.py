"""Links of pages against an HTML parser of the standard library."""

from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

from sievework.llm import queries
from sievework.llm.url_filter import judge_urls, link_edges

SF = "/root/testdata/sf0.001"
PAGE = "http://e.org/dir/page"


class Links(HTMLParser):
    """Targets of canonical links and refreshes."""

    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        a = {}
        for name, value in attrs:
            a.setdefault(name, value or "")
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.found.append(a.get("href", ""))
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
            rest = a.get("content", "").strip().lstrip("0123456789.").lstrip(" ;,")
            if rest[:3].lower() == "url" and rest[3:].lstrip()[:1] == "=":
                rest = rest[3:].lstrip()[1:].lstrip()
            quote = rest[:1]
            self.found.append(rest[1:].split(quote)[0] if quote and quote in "'\"" else rest)


def parsed(url, html):
    parser = Links()
    parser.feed(html)
    targets = (v.strip() for v in parser.found if v.strip() and not v.strip().startswith(("#", "mailto:")))
    return sorted(urldefrag(urljoin(url, t)).url.split("://", 1)[1] for t in targets)


CASES = [
    "<!-- <link rel=canonical href=http://b.org/1> --><link data-x='>' rel=canonical href='http://b.org/2'>",
    "<link rel='canonical' href='http://b.org/1'><LINK HREF=\"http://b.org/2\" REL=\"nofollow Canonical\"/>",
    "<script>x = \"<link rel=canonical href=http://b.org/1>\"</script><link rel=canonical href=/2>",
    "<style>a{}<link rel=canonical href=/1></style><meta http-equiv=refresh content='5;URL=http://b.org/3'>",
    "<meta http-equiv='Refresh' content=\"0; url='http://b.org/a b'\"><meta http-equiv=refresh content=30>",
    "<p title=\"<link rel=canonical href=/1>\">it's <link rel=canonical href=http://b.org/x/>",
    "<link rel=alternate href=/1><link rel='not-canonical' href=/2><link rel='canonicals' href=/3><linker rel=canonical href=/4>",
    "<link rel=canonical rel=alternate href=?q=1&amp;r=http://b.org/z href=/5>",
    "<link\nrel\n=\ncanonical\nhref = \"other\"><link rel=canonical href='#part'><link rel=canonical href='mailto:a@b.c'>",
    "<a data-n=1 data-rel=canonical><link data-rel=canonical href=/1><link rel=canonical data-href=/1>",
    "<link rel=canonical href=//h.org/1><!----><link rel=canonical href=/2>",
    "<link rel=canonical href='/1" + "x" * 20_000 + "' " + " ".join(f"d{i}='>{i}'" for i in range(20_000)) + ">",
    "", "<", "<!--", "no tags", "< link rel=canonical href=/1>", "<link rel=canonical>", "<link rel=canonical href=''>",
]


def edges(spark, rows):
    out = {}
    for r in link_edges(spark.createDataFrame(rows, "url string, html string")).collect():
        out.setdefault(r.a, []).append(r.b)
    return {k: sorted(v) for k, v in out.items()}


def test_links_against_a_parser(spark):
    got = edges(spark, [(f"{PAGE}{i}", html) for i, html in enumerate(CASES)])
    for i, html in enumerate(CASES):
        assert got.get(f"e.org/dir/page{i}", []) == parsed(f"{PAGE}{i}", html), html[:200]


def test_links_of_the_test_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").where("url is not null").select("url", "html").collect()
    want = {}
    for r in rows:
        targets = parsed(r.url, r.html or "")
        if "://" in r.url and targets:
            want.setdefault(urldefrag(r.url).url.split("://", 1)[1], []).extend(targets)
    got = edges(spark, [tuple(r) for r in rows])
    assert sum(map(len, got.values())) == sum(map(len, want.values()))


def test_a_comment_may_be_closed_at_once(spark):
    assert edges(spark, [(PAGE, "<!--><link rel=canonical href=/3>-->")]) == {"e.org/dir/page": ["e.org/3"]}


def test_links_in_comments_block_nothing(spark):
    rows = [
        (1, "http://a.net/es/1", "<!-- <link rel=canonical href=http://b.org/1> --><link data-x='>' rel=canonical href=http://b.org/2>"),
        (2, "http://b.org/1", None),
        (3, "http://b.org/2", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in judge_urls(pages, queries.URL_RULES).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}
    assert {r.verdict for r in judge_urls(pages.drop("html"), queries.URL_RULES).where("page_id > 1").collect()} == {"allow"}
