from __future__ import annotations

import json

import pytest

from siftline.operators.reports import source_outcomes
from siftline.sources import feeds, registry
from siftline.sources.payloads import PAYLOAD, problems, open_json, read_landing

RSS = """<?xml version="1.0"?><rss xmlns:media="http://search.yahoo.com/mrss/"><channel><title>t</title>
<item><title>Acme: Lead: Data</title><link> </link><link>https://a.example/1</link><media:content url="x"/></item>
<item><title>No link</title></item>
<item><title/><link>https://a.example/2</link><pubDate></pubDate></item></channel></rss>"""


@pytest.fixture(scope="module")
def landed(spark):
    def build(*rows):
        full = [(r[0], r[1], f"p{i}", r[2] if len(r) > 4 else "listings", r[-2], r[-1]) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, PAYLOAD)

    return build


def test_irregular_records(landed):
    body = [
        {"legal": "x", "url": "https://n"},
        {"position": "no url"},
        "text",
        [1],
        {"id": 7, "position": None, "tags": "python", "salary": 120000, "apply_url": " https://a.example/7 ", "company": False},
    ]
    rows = feeds.read_remoteok(landed(("remoteok", None, json.dumps(body), None))).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["url"], row["external_id"], row["title"], row["company"], row["compensation_text"], row["tags"]) == (
        "https://a.example/7", "7", None, None, "120000", [],
    )
    assert json.loads(row["raw"])["salary"] == 120000


@pytest.mark.parametrize("body", ["{}", '{"jobs": null}', '{"jobs": {}}', "[]", "not json", "null"])
def test_wrong_envelope_is_an_error_not_empty(landed, body):
    payload = landed(("remotive", None, body, None))
    assert feeds.read_remotive(payload).count() == 0
    assert feeds.problems_remotive(payload).count() == 1


def test_empty_feed_is_no_error(landed):
    payload = landed(("remotive", None, '{"jobs": []}', None))
    assert feeds.read_remotive(payload).count() == 0 and feeds.problems_remotive(payload).count() == 0


def test_rss(landed):
    rows = sorted(feeds.read_weworkremotely(landed(("weworkremotely", None, RSS, None))).collect(), key=lambda r: r["url"])
    assert [(r["url"], r["company"], r["title"], r["posted_at_text"]) for r in rows] == [
        ("https://a.example/1", "Acme", "Lead: Data", None),
        ("https://a.example/2", None, None, None),
    ]
    broken = landed(("weworkremotely", None, "<rss><channel>", None))
    assert feeds.read_weworkremotely(broken).count() == 0
    assert [r["problem"] for r in feeds.problems_weworkremotely(broken).collect()] == ["malformed RSS"]


def _thread(landed, *titles):
    stories = {"hits": [{"objectID": str(i), "title": t, "created_at": f"2026-0{i}"} for i, t in enumerate(titles, 1)]}
    ad = "Acme | Engineer<p>" + "x" * 120
    comments = {
        "hits": [
            {"objectID": "10", "parent_id": 2, "comment_text": ad},
            {"objectID": "11", "parent_id": 10, "comment_text": ad},
            {"objectID": "12", "parent_id": 2, "comment_text": "short"},
            {"objectID": "13", "parent_id": 2, "comment_text": "<p> </p>" * 20},
            {"parent_id": 2, "comment_text": ad},
        ]
    }
    return landed(
        ("hackernews", None, "stories", json.dumps(stories), None), ("hackernews", None, "comments", json.dumps(comments), None)
    )


def test_thread(landed):
    payload = _thread(landed, "Ask HN: Who is hiring? (1)", "ask hn: who is  hiring?", "Ask HN: Who wants to be hired?")
    assert feeds.latest_thread(payload).first()["story_id"] == "2"
    rows = feeds.read_hackernews(payload).collect()
    assert [(r["url"], r["title"], r["company"]) for r in rows] == [
        ("https://news.ycombinator.com/item?id=10", "Acme | Engineer", None)
    ]
    assert feeds.problems_hackernews(payload).count() == 0


def test_no_thread_is_an_error(landed):
    payload = _thread(landed, "Launch HN")
    assert feeds.read_hackernews(payload).count() == 0
    assert [r["problem"] for r in feeds.problems_hackernews(payload).collect()] == ["no 'Who is hiring?' story found"]


def test_company_feeds(landed):
    green = {"jobs": [{"id": 1, "title": "A", "absolute_url": "https://g/1", "location": "x", "content": "&lt;p&gt;a &amp;amp; b&lt;/p&gt;"}]}
    lever = [{"text": "L", "applyUrl": "https://l/1", "createdAt": 1757932800123, "categories": "x", "salaryRange": {"min": 1}}, {"applyUrl": "https://l/2", "createdAt": "1757932800123"}]
    ashby = {"jobs": [{"jobUrl": "https://a/1", "compensation": {"compensationTierSummary": "$1k"}}, {"jobUrl": "https://a/2", "compensation": "c", "organizationName": "Org"}]}
    payload = landed(("greenhouse", "acme", json.dumps(green), None), ("lever", "acme", json.dumps(lever), None), ("ashby", "acme", json.dumps(ashby), None))
    g = feeds.read_greenhouse(payload).first()
    assert (g["company"], g["description"], g["location_text"]) == ("acme", "<p>a &amp; b</p>", None)
    posted = {r["url"]: (r["posted_at"], r["compensation_text"]) for r in feeds.read_lever(payload).collect()}
    assert posted["https://l/1"][0].isoformat() == "2025-09-15T10:40:00.123000" and posted["https://l/2"] == (None, None)
    a = {r["url"]: (r["company"], r["compensation_text"]) for r in feeds.read_ashby(payload).collect()}
    assert a == {"https://a/1": ("acme", "$1k"), "https://a/2": ("Org", None)}


def test_failed_boards_are_isolated(spark, landed):
    good = '{"jobs": [{"absolute_url": "https://g/1"}]}'
    chosen = registry.build_sources(["greenhouse", "lever", "remotive"], {"greenhouse": ["a", "b"], "lever": ["a"]})
    payload = landed(
        ("greenhouse", "a", good, None), ("greenhouse", "b", None, "HTTP 500"), ("lever", "a", None, "HTTP 404"), ("remotive", None, '{"jobs":[]}', None)
    )
    rows = registry.union_sources(payload, chosen)
    errors = registry.source_errors(registry.source_problems(payload, chosen), rows)
    out = {r["source"]: (r["fetched"], r["error"], r["state"]) for r in source_outcomes(registry.configured(spark, chosen), rows, errors).collect()}
    assert out == {
        "greenhouse": (1, None, "ok"),
        "lever": (0, "all 1 configured boards failed: HTTP 404", "error"),
        "remotive": (0, None, "empty"),
    }


def test_only_configured_boards_and_a_bad_payload_among_good_ones(spark, landed):
    board = lambda n: '{"jobs": [{"absolute_url": "https://g/%d"}]}' % n
    chosen = registry.build_sources(["greenhouse", "remotive"], {"greenhouse": [" a "]})
    payload = landed(
        ("greenhouse", "a", board(1), None), ("greenhouse", "b", board(2), None), ("greenhouse", "c", None, "HTTP 500"),
        ("remotive", None, '{"jobs":[{"url": "https://r/1"}]}', None), ("remotive", None, None, "HTTP 502"),
    )
    rows, problems = registry.union_sources(payload, chosen), registry.source_problems(payload, chosen)
    assert sorted(r["url"] for r in rows.collect()) == ["https://g/1", "https://r/1"]
    assert [r["source"] for r in problems.collect()] == ["remotive"]
    out = source_outcomes(registry.configured(spark, chosen), rows, registry.source_errors(problems, rows))
    assert {(r["source"], r["fetched"], r["state"]) for r in out.collect()} == {("greenhouse", 1, "ok"), ("remotive", 1, "ok")}


def test_registry():
    assert len(registry.available_sources()) == 7
    with pytest.raises(ValueError):
        registry.build_sources(["monster"])
    assert list(registry.build_sources(["lever", "remoteok"], {"lever": [" "]})) == ["remoteok"]


def test_landing_folder(spark, tmp_path):
    def put(source, company, name, body):
        folder = tmp_path / f"source={source}" / f"company={company}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(body, encoding="utf-8")

    put("lever", "acme", "1.json", '[{"text": "L",\n "hostedUrl": "https://l/1"}]')
    put("lever", "other", "1.error", "HTTP 503\n")
    put("weworkremotely", "__HIVE_DEFAULT_PARTITION__", "1.xml", RSS)
    put("hackernews", "__HIVE_DEFAULT_PARTITION__", "stories-1.json", '{"hits": []}')
    payload = read_landing(spark, str(tmp_path))
    kinds = {(r["source"], r["company"], r["kind"], r["error"]) for r in payload.collect()}
    assert kinds == {
        ("lever", "acme", "listings", None),
        ("lever", "other", "listings", "HTTP 503"),
        ("weworkremotely", None, "listings", None),
        ("hackernews", None, "stories", None),
    }
    assert [r["company"] for r in feeds.read_lever(payload).collect()] == ["acme"]
    assert feeds.read_weworkremotely(payload).count() == 2
    assert problems(open_json(payload.filter("source = 'lever'"), None)).count() == 1
