from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import dates, hashing, markup, text, urls

L = F.lit


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("https://x.com/senate-measure/?utm_campaign=rss", "https://x.com/senate-measure"),
        ("http://www.fda.gov/a", "https://www.fda.gov/a"),
        ("https://endpts.com/some-story/", "https://endpoints.news/some-story"),
        ("HTTPS://User:p@A.Com:443/x//?b=2&a=1&ref=z#f", "https://a.com/x?a=1&b=2"),
        ("http://x.com", "http://x.com/"),
        ("not a url", "notaurl"),
        ("", ""),
    ],
)
def test_canonical_url(one, raw, wanted):
    assert one(urls.canonical_url(L(raw))) == wanted


def test_ids(one):
    assert one(urls.extract_doi(L("see doi:10.1038/s41586-021-03819-2. And"))) == "10.1038/s41586-021-03819-2"
    assert one(urls.extract_doi(L("none"))) is None
    assert one(urls.host_of(L("https://A.b.com:80/x"))) == "a.b.com"
    assert len(one(urls.item_id(L("x")))) == 16
    assert one(urls.cluster_id(F.array(L("b"), L("a")))) == one(urls.cluster_id(F.array(L("a"), L("b"))))


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("<p>First sentence.</p><p>Second sentence.</p>", "First sentence. Second sentence."),
        ("&lt;p&gt;Escaped &amp;amp; more&lt;/p&gt;", "Escaped & more"),
        ("<script>x<b></script>a<img src=x>b &#233;&#xe9;", "a b éé"),
        ("", ""),
    ],
)
def test_html_to_text(one, html, wanted):
    assert one(markup.html_to_text(L(html))) == wanted


def test_titles(one):
    assert one(markup.clean_title_markup(L("CCR7<sup>+</sup> activated"))) == "CCR7+ activated"
    assert one(markup.clean_title_markup(L("p<0.05 in n>10 patients"))) == "p<0.05 in n>10 patients"
    assert one(text.normalize_title(L("STAT+: Foo & bar - Outlet News"))) == "Foo and bar"
    assert one(markup.strip_journal_boilerplate(L("Nature Medicine, Published online: 1 May 2026; doi:10.1038/s1-2 Text"))) == "Text"


@pytest.mark.parametrize(
    "raw, zone, wanted, precision, confident",
    [
        ("Jul 31, 2026 8:59am", "America/New_York", datetime(2026, 7, 31, 12, 59), "minute", True),
        ("Jan 15, 2026 8:59am", "America/New_York", datetime(2026, 1, 15, 13, 59), "minute", True),
        ("2026-08-03", None, datetime(2026, 8, 3, 12), "day", True),
        ("Wed, 29 Jul 2026 12:10:31 EDT", None, datetime(2026, 7, 29, 16, 10, 31), "second", True),
        ("29 Jul 2026 12:10:31 +0200", None, datetime(2026, 7, 29, 10, 10, 31), "second", True),
        ("not a date at all", None, None, "unknown", False),
        ("2027-01-01T00:00:00Z", None, datetime(2026, 8, 4, 12), "second", False),
        ("2026-08-01T10:00+02:00", None, datetime(2026, 8, 1, 8), "minute", True),
    ],
)
def test_feed_dates(one, raw, zone, wanted, precision, confident):
    found = one(dates.parse_feed_date(L(raw), L(zone).cast("string"), L("2026-08-03").cast("timestamp")))
    assert (found.date, found.precision, found.confident) == (wanted, precision, confident)


def test_weeks(one):
    assert one(dates.iso_week(L("2026-08-03").cast("date"))) == "2026-W32"
    assert one(dates.shift_month(L("2026-01"), -1)) == "2025-12"


def test_tokens_and_sets(one):
    assert one(text.tokenize(L("Éa The Über-cool naïve ß x fox"))) == ["ea", "uber", "cool", "naive", "fox"]
    assert one(text.tokenize(L(None).cast("string"))) == []
    assert one(text.shingles(F.array(L("ab"), L("cd")))) == ["ab ", "b c", " cd"]
    assert one(text.shingles(F.array(L("a")))) == []
    assert one(text.jaccard(F.array(L(1), L(2)), F.array(L(2), L(3)))) == pytest.approx(1 / 3)
    assert one(text.dice(F.array(L(1)), F.array().cast("array<int>"))) == 0
    assert one(text.squish(L(" a  b\n"))) == "a b"


def test_truncation_and_sentences(one):
    assert one(text.truncate_words(L("hello world, this is long"), 14)) == "hello world…"
    assert one(text.truncate_words(L("short"), 14)) == "short"
    assert one(text.sentence_around(L("First one. Second (HR 0.94) here. Third."), L(15))) == "Second (HR 0.94) here."
    assert one(text.count_term(L("trials trial, trial the trial"), "trial")) == 3
    assert one(text.floor_round(L(-2.5), 0)) == -2


def test_hash_lanes(one):
    def lanes(s):
        hi = lo = 0x811C9DC5
        for i, c in enumerate(s):
            lo = ((lo ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
            hi = ((hi ^ ((ord(c) << 3) | (i & 7))) * 0x01000193) & 0xFFFFFFFF
        return hi, lo

    for s in ("hello", "", "drug:abc"):
        hi, lo = hashing.fnv_lanes(L(s))
        assert (one(hi), one(lo)) == lanes(s)
    assert one(hashing.hamming(L(5), L(6))) == 2


def test_wrong_shape(one):
    assert one(markup.wrong_shape(L("<html><title>Denied</title>"), L("json"))) == "page instead of json: denied"
    assert one(markup.wrong_shape(L('{"a":1}'), L("json"))) is None
    assert one(markup.wrong_shape(L(" "), L("xml"))) == "empty body"
