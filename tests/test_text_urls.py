import pytest
from pyspark.sql import functions as F

from tidepool.functions import html, plain, text, urls


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values) or "x string")
    return row.select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [('Usage[](#usage "Direct link to Usage")', "Usage"), ("### Network {#net}", "Network"), ("Read [the rules](x) ¶", "Read the rules"), ("", None), ("  ", None)],
)
def test_clean_heading(spark, raw, clean):
    assert one(spark, text.clean_heading(F.col("x")), x=raw) == clean == plain.clean_heading(raw)


@pytest.mark.parametrize(("raw", "title"), [("Volumes | Harbour", "Volumes"), ("Start — Manual", "Start"), ("", "Untitled"), ("One | Two | Three", "One | Two")])
def test_title(spark, raw, title):
    assert one(spark, text.normalize_title(F.col("x")), x=raw) == title == plain.normalize_title(raw)


def test_bodies_agree(spark):
    for raw in ("p\n\n\n\n\nq", "see [rules](https://a.b/c) now", "<!-- one\ntwo -->three<hr/>four  five \t\nsix", "seven¶ [](#eight)"):
        assert one(spark, text.clean_body(F.col("x")), x=raw) == plain.clean_body(raw)


@pytest.mark.parametrize(("x", "n"), [("", 0), ("é", 1), ("four", 1), ("fivef", 2), ("b" * 81, 21)])
def test_tokens(spark, x, n):
    assert one(spark, text.estimate_tokens(F.col("x")), x=x) == n == plain.estimate_tokens(x)


def test_near_duplicates(spark):
    base = "The gateway closes idle connections after ninety seconds and writes one line to the audit log for each of them."
    head = base[:100] * 3
    for a, b, same in (
        (base, base.upper(), True), (base, f"Note. {base}", True), (base, f"{base} {base[:40]}", False), (base, "Nothing of that kind is said here, although the text is long enough to be looked at.", False), ("", base, True),
        ("short text", "short text too", False), (head, head[:250] + "x" * 40, True), (head, head[:200] + "x" * 100, False),
    ):
        assert one(spark, text.near_duplicate(F.col("a"), F.col("b")), a=a, b=b) is same is plain.near_duplicate(a, b) is plain.near_duplicate(b, a)


def test_truncate():
    assert plain.truncate("abc", 3) == "abc" and plain.truncate("abc", 0) == ""
    assert plain.truncate("first part\n\nsecond one. third word", 25) == "first part\n…"
    assert plain.truncate("One. Two three. Four five six", 22) == "One. Two three.\n…"
    assert plain.truncate("alpha beta gamma", 13) == "alpha beta\n…"
    assert plain.truncate("a. " + "b" * 50, 20) == "a. " + "b" * 17 + "\n…"  # both cuts would come too early


def test_labels_and_leads():
    assert plain.section_label("## Setup {#s}", "T", None, "u") == "Setup"
    assert plain.section_label("import os", "const x;", "A > B", "u") == "const x;"
    assert plain.section_label("if (x) {", None, "A > B", "u") == "A > B"
    assert plain.section_label(None, " ", "let y", "https://e.com/d/my%20file.md?x") == "my file.md"
    assert plain.section_label(None, None, None, "") == "Excerpt"
    assert [plain.is_weak_heading(x) for x in ("", "a {", "b;", "import x", "importer", "test (1)", "testing", None)] == [True, True, True, True, False, True, False, True]
    assert plain.strip_lead("\n# Setup\n\nbody", "setup") == "body" and plain.strip_lead("## Setup guide\nbody", "Setup") == "body" and plain.strip_lead("# Set\nbody", "Setup") == "body"
    assert plain.strip_lead("# Other\nbody", "Setup") == "# Other\nbody" and plain.strip_lead("# Setup\n \n", "Setup") == "# Setup\n \n" and plain.strip_lead("body", None) == "body"


@pytest.mark.parametrize(
    ("code", "name"),
    [
        ("// note\nimport a\nexport default async function load(x) {", "load"), ('suite("the cache", () => {', "the cache"), ("let limit = 3;", "limit"), ("    async def fetch(self):", "fetch"), ("func (s *Server) Run() {", "Run"), ("pub fn main() {", "main"),
        ("pub struct Point {", "pub struct Point"), ("impl Trait for X {", "impl Trait for X"), ("x = 1\ny = 2", "f.py"), ("class Tree(Base):", "Tree"), ("#" * 3 + "\n" * 20 + "def late(): pass", "f.py"),
    ],
)
def test_code_headings(code, name):
    assert plain.code_heading(code, "src/f.py") == name


def test_redact(spark):
    out = one(spark, text.redact(F.col("x")), x="Authorization: Bearer abc.def token=verysecret sk-abcdefghijklm")
    assert "verysecret" not in out and "abc.def" not in out and "sk-abc" not in out


def test_boilerplate(spark):
    assert one(spark, text.is_boilerplate(F.col("x")), x="ok") is True
    assert one(spark, text.is_boilerplate(F.col("x")), x="```\ncode\n```") is False


@pytest.mark.parametrize(
    ("url", "normal"),
    [("HTTPS://Api.Example.org:443/Guide/#intro", "https://api.example.org/Guide"), ("http://h.org/a/INDEX.htm", "http://h.org/a"), ("https://h.org?gclid=1&q=2&utm_x=3", "https://h.org/?q=2"), ("mailto:a@b", None)],
)
def test_normalize(spark, url, normal):
    assert one(spark, urls.normalize(F.col("x")), x=url) == normal


def test_segments(spark):
    path, version = urls.strip_version(F.col("x"))
    assert one(spark, F.concat_ws(" ", path, version), x="/handbook/v3.1.2-rc.1/tour") == "/handbook/tour v3.1.2-rc.1"
    assert one(spark, F.concat_ws(" ", path, version), x="/handbook/v3/tour") == "/handbook/v3/tour"
    path, tag = urls.strip_locale(F.col("x"))
    assert one(spark, F.concat_ws(" ", path, tag), x="/pt_BR/help/start") == "/help/start pt_BR"
    assert one(spark, F.concat_ws(" ", path, tag), x="/help/js/start") == "/help/js/start"


def test_dedupes(spark):
    rows = [(0, "https://h.org/help/ko/disk"), (1, "https://h.org/help/disk"), (2, "https://h.org/help/it/net"), (3, "https://h.org/help/net"), (4, "https://h.org/help/en-gb/log"), (5, "https://h.org/help/pl/rare")]
    got = {r.url for r in urls.dedupe_locales(spark.createDataFrame(rows, "pos int, url string")).collect()}
    assert got == {"https://h.org/help/disk", "https://h.org/help/net", "https://h.org/help/en-gb/log", "https://h.org/help/pl/rare"}
    rows = [(0, "https://h.org/m/2.4/disk"), (1, "https://h.org/m/stable/net"), (2, "https://h.org/m/disk"), (3, "https://h.org/m/2.5/net"), (4, "https://h.org/m/plain")]
    got = {r.url for r in urls.dedupe_versions(spark.createDataFrame(rows, "pos int, url string")).collect()}
    assert got == {"https://h.org/m/disk", "https://h.org/m/stable/net", "https://h.org/m/plain"}


def test_page():
    page = html.extract('<html lang="de"><head><title>Disks | Harbour</title><link rel="canonical" href="https://h.org/disks"></head><body class="sphinx"><nav>Menu</nav><div class="rst-content"><h1>Disks<a class="headerlink" title="Permalink to Disks">¶</a></h1><p>' + "Disks are slow. " * 12 + '</p><table><tr><th>Kind</th><th>Size</th><th>Use</th></tr><tr><td>ssd</td><td>2</td></tr></table><pre><code class="language-sh">df -h</code></pre><div class="pagination">Next page</div></div></body></html>')
    assert page["title"] == "Disks" and page["adapter"] == "sphinx" and page["lang"] == "de" and page["canonical"] == "https://h.org/disks"
    assert "| Kind | Size | Use |" in page["markdown"] and "| ssd | 2 | |" in page["markdown"] and "```sh\ndf -h\n```" in page["markdown"]
    assert "Next page" not in page["markdown"] and "Permalink" not in page["markdown"] and "Menu" not in page["markdown"]


def test_follow_redirects(spark):
    from tidepool.sources import discovery

    chain = [(f"https://s.org/{i}", 302, f"/{i + 1}", f"hop {i}", "text/html") for i in range(3)]
    stored = chain + [
        ("https://s.org/3", 200, None, "end", "text/html"), ("https://s.org/3", 200, None, "later", "text/html"), ("https://s.org/twice", 200, None, "page", "text/html"), ("https://s.org/twice", 301, "/3", None, None),
        ("https://s.org/loop", 302, "/loop", "", None), ("https://s.org/odd", 302, "mailto:x", None, None), (None, 200, None, "x", None),
    ]
    responses = spark.createDataFrame(stored, "url string, status int, location string, body string, content_type string")
    asked = spark.createDataFrame([(f"https://s.org/{p}",) for p in ("0", "0", "twice", "loop", "odd", "none")] + [(None,), ("https://t.org/0",)], "url string")
    got = [(r.url, r.ok, r.final, r.body, r.error) for r in discovery.follow(asked, responses, "https://s.org").collect()]
    at, end = "https://s.org/", ("https://s.org/3", "end", None)
    want = [(f"{at}{p}", True, *end) for p in ("0", "0", "twice")] + [
        (f"{at}loop", False, f"{at}loop", None, "too many redirects"), (f"{at}odd", False, None, None, "invalid address"), (f"{at}none", False, f"{at}none", None, "no response"),
        (None, False, None, None, "invalid address"), ("https://t.org/0", False, "https://t.org/0", None, "out of scope"),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    short = discovery.follow(asked.limit(1), responses, "https://s.org", hops=2).first()
    assert (short.ok, short.final, short.error) == (False, "https://s.org/2", "too many redirects")
    assert discovery.follow(asked, responses.limit(0), "https://s.org").where("ok").isEmpty()
