"""URL filter: hosts, paths and rules against plain Python, templates by example."""

import random
import re

from labelloom.llm import queries, url_templates

RULES = queries.URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule(host, path):
    best = None
    for action, text in RULES:
        domain, _, start = text.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            if best is None or len(text) > len(best[1]):
                best = action, text
    return best or (None, None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)],
                                 "page_id long, url string, host string, rule string")


def none(spark):
    return spark.createDataFrame([], "url_label_key long, good int")


def test_rules_on_odd_urls(spark):
    r = random.Random(2)
    bits = ["http://", "://", "EXAMPLE.com", "example.net", "org", ".", "/", "en/", "de/8", "es/", "?", "#", "7", "É", "com", "net", "\n", " "]
    urls = ["".join(r.choice(bits) for _ in range(r.randint(0, 9))) for _ in range(400)]
    urls += [None, "", "http://a.example.com/en/7?x", "https://com/en/", "http://xcom/en/", "http://org/es/1", "http://example.net/de/81",
             "HTTP://WWW.Example.NET/de/9"]
    got = {x.page_id: x for x in url_templates.judge(pages(spark, urls), none(spark), RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = parts(u)
        action, text = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, text), u
        assert got[i].verdict == (action or "allow")


def test_bad_templates_are_rejected_and_variable_segments_merge(spark):
    urls, labels = [], []
    for i in range(300):
        section = ("news", "blog", "spam")[i % 3]
        urls.append(f"https://h.example/{section}/item-{i}/{'abcdef'[i % 6]}{i * 7919 % 1000}/{i}")
        labels.append((i, 0 if section == "spam" else 1))
    labels += [(0, 0), (5000, 1)]  # contradicting and unknown keys change nothing
    known = spark.createDataFrame(labels, "url_label_key long, good int")
    got = url_templates.judge(pages(spark, urls), known, ()).collect()
    assert all((r.verdict == "block") == ("/spam/" in r.path) for r in got)
    assert {r.template.split("/")[1] for r in got} == {"spam", "*"}


def test_a_host_with_all_pages_and_an_empty_table(spark):
    urls = ["https://one.example/a/1"] * 500
    got = url_templates.judge(pages(spark, urls), none(spark), RULES).collect()
    assert len(got) == 500 and {r.verdict for r in got} == {"allow"}
    assert url_templates.judge(pages(spark, urls).limit(0), none(spark), RULES).collect() == []


def test_query_on_the_whole_table(spark, sf_dir):
    want = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.QUERIES["op5_url_templates"](spark, sf_dir).collect()
    assert len(rows) == len(want)
    for r in rows:
        host, path = parts(want[r.page_id])
        action, text = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, text) and r.verdict in ("allow", "block")
        assert action is None or r.verdict == action


def test_many_siblings_do_not_chain_bad_ones_to_good_ones(spark):
    urls, labels = [], []
    for section in range(40):
        for page in range(50):
            i = section * 50 + page
            urls.append(f"https://h.example/x{'abcdefgh'[section // 8]}{'ijklmnop'[section % 8]}/{i}")
            labels.append((i, 0 if page < section * 50 / 39 else 1))
    known = spark.createDataFrame(labels, "url_label_key long, good int")
    got = {r.page_id: r for r in url_templates.judge(pages(spark, urls), known, ()).collect()}
    verdicts = [got[section * 50].verdict for section in range(40)]
    assert verdicts[:10] == ["allow"] * 10 and verdicts[-10:] == ["block"] * 10
    # Siblings that differ significantly share no template.
    bad = [sum(page < section * 50 / 39 for page in range(50)) for section in range(40)]
    for x in range(40):
        for y in range(x):
            pooled = (bad[x] + bad[y]) / 100
            spread = pooled * (1 - pooled) * (2 / 50)
            if spread > 0 and ((bad[x] - bad[y]) / 50) ** 2 >= 1.96**2 * spread:
                assert got[x * 50].template != got[y * 50].template
