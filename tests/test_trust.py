
from recollect.functions import trust as tr
from recollect.settings import DEFAULTS
from tests.helpers import evaluate

CASES = {
    None: 0.5, "": 0.5, "  ": 0.5,
    "https://docs.python.org/3/": 1.0, "https://example.gov/p": 1.0, "https://uni.edu": 1.0,
    "https://en.wikipedia.org/wiki/X": 1.0, "https://notwikipedia.org/": 0.4, "https://blog.example/p": 0.4,
    "www.github.com/a": 1.0, "https://user@github.com:443/a": 1.0, "www.": 0.4, "http://": 0.5,
    "ROADMAP.md": 0.8, "docs/a.bin": 0.8, "sessions/x": 0.8, "note": 0.5, "a.md.bak": 0.5,
}


def test_source_trust(spark):
    assert evaluate(spark, list(CASES), tr.source_trust) == list(CASES.values())


def test_trust_settings(spark):
    own = DEFAULTS.overlay({"trust": {"domains": ["corp.example"], "trusted": 0.9}}).trust
    got = evaluate(spark, ["https://a.corp.example/", "https://github.com/"], lambda c: tr.source_trust(c, own))
    assert got == [0.9, 0.4]


def test_host(spark):
    urls = ["HTTPS://User@Docs.Python.org:80/x", "plain.host/p", "1bad://h/x", ".a.b.", "ftp://x?q"]
    assert evaluate(spark, urls, tr.url_host) == ["docs.python.org", "plain.host", "", "a.b", "x"]


def test_clamp(spark):
    assert evaluate(spark, ["2", "-1", "0.3", "x", None], tr.clamp_trust) == [1.0, 0.0, 0.3, 0.5, 0.5]


def test_trusted_domain_needs_a_dot_for_zones(spark):
    assert evaluate(spark, ["gov", "a.gov", "docs", "help.x", ""], tr.trusted_domain) == [False, True, True, True, False]
