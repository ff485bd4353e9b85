import math
import re
from collections import Counter

import compare
import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from foliospark.llm import urlfilter
from foliospark.llm.queries import ORACLES, QUERIES, URL_RULES


def plain(url):
    """Host, path, rule and the rule's verdict of one url."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = (0, None, None)
    for verdict, rule in URL_RULES:
        of, _, start = rule.partition("/")
        fits = (host == of or host.endswith("." + of)) and path.startswith("/" + start)
        if fits and len(rule) > best[0]:
            best = (len(rule), rule, verdict)
    return host, path, best[1], best[2]


URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "HTTP://WWW.Example.COM/en/1?x#y",
    "http://example.com/en/2",
    "http://example.com/de/2",
    "http://example.com?en/",
    "http://xexample.com/en/9",
    "http://a.net/es/1",
    "http://a.net/es",
    "http://a.net#/es/1",
    "http://net/fr/1",
    "http://É.net/fr/1",
    "http://a.org//en///7/8/9/10.html",
    "a://b://c/d",
]


def test_query_matches_sql_and_rules(spark):
    found = QUERIES["op4_urls"](spark, SF_DIR)
    assert compare.difference(found, compare.connect(SF_DIR), ORACLES["op4_urls"]) is None
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in found.collect():
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict)


def learned_rows():
    """A host whose labelled sections agree, and pages that no rule reaches."""
    rows = [f"http://h.net/es/{k}.html" for k in range(40)]
    rows += [f"http://h.net/fr/{k}" for k in range(40)]
    rows += [f"http://h.net/en/{k}" for k in range(40)]
    rows += ["http://h.net/es"] + [f"http://p.com/{w}" for w in "abcdefghijklmnop"]
    return rows


@pytest.mark.parametrize("urls", [URLS * 2, learned_rows()])
def test_odd_urls_against_sql(spark, urls):
    rows = [(k if k % 7 else None, u, "x") for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = urlfilter.judge(pages, URL_RULES)
    database = duckdb.connect()
    table = pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows]})
    database.register("pages", table)
    assert compare.difference(found, database, ORACLES["op4_urls"]) is None


def test_similar_sections_are_merged_and_judge_what_no_rule_reaches(spark):
    rows = list(enumerate(learned_rows()))
    found = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES)
    by_path = {(r.host, r.path): r for r in found.collect()}
    assert by_path["h.net", "/es/1.html"].template == by_path["h.net", "/fr/1"].template == "h.net/"
    assert by_path["h.net", "/es"].verdict == "block"  # learned
    assert by_path["h.net", "/en/1"].verdict == "allow"


def plain_templates(paths):
    """Template and first segment of each (host, segments), by recursion over the tree."""
    found = {}

    def generalised(segment, variable):
        if variable or re.search("[0-9]", segment):
            extension = re.search("[.][A-Za-z]+$", segment)
            return "*" + (extension[0] if extension else "")
        return segment

    def descend(rows, level, template, first):
        pages = sum(n for _, _, n in rows)
        different = {segments[level] if len(segments) > level else "" for _, segments, _ in rows}
        variable = len(different) >= 10 and len(different) >= 0.5 * pages
        below = {}
        for path, segments, n in rows:
            if len(segments) <= level:
                found[path] = (template, first)
            else:
                name = generalised(segments[level], variable)
                below.setdefault(name, []).append((path, segments, n))
        for name, part in below.items():
            descend(part, level + 1, template + "/" + name, name if level == 0 else first)

    hosts = {}
    for (host, path), n in paths.items():
        segments = [s for s in path.split("/") if s]
        hosts.setdefault(host, []).append(((host, path), segments, n))
    for rows in hosts.values():
        descend(rows, 0, "", "")
    return found


def plain_verdicts(urls):
    """Template and verdict of every located page, in plain loops."""
    located = [plain(url) for url in urls]
    paths, labels = Counter(), {}
    for host, path, _, ruled in located:
        paths[host, path] += 1
        n, b = labels.get((host, path), (0, 0))
        labels[host, path] = (n + (ruled is not None), b + (ruled == "block"))
    templates = plain_templates(paths)

    def pooled(key):
        sums = {}
        for path, (template, first) in templates.items():
            name = key(path[0], template, first)
            n, b = sums.get(name, (0, 0))
            sums[name] = (n + labels[path][0], b + labels[path][1])
        return sums

    def like(part, pool):
        if not pool[0]:
            return False
        share = pool[1] / pool[0]
        off = abs(part[1] - part[0] * share)
        return off <= 0.5 + 1.96 * math.sqrt(part[0] * share * (1 - share))

    leaves = pooled(lambda host, template, first: (host, template, first))
    branches = pooled(lambda host, template, first: (host, first))
    hosts = pooled(lambda host, template, first: host)
    total = [sum(v[k] for v in hosts.values()) for k in (0, 1)]
    merged = {k: v[0] > 0 and like(v, hosts[k[0]]) for k, v in branches.items()}
    pools = {h: [sum(branches[k][i] for k in branches if k[0] == h and merged[k]) for i in (0, 1)] for h in hosts}
    found = []
    for host, path, rule, ruled in located:
        template, first = templates[host, path]
        branch = branches[host, first]
        n, b = leaves[host, template, first]
        name = host + (template or "/")
        if branch[0] and like((n, b), branch):
            name, (n, b) = f"{host}/{first}/", branch
            if merged[host, first]:
                name, (n, b) = f"{host}/", pools[host]
        learned = "allow"
        if n and (b + 5.0 * total[1] / total[0]) / (n + 5.0) >= 0.9:
            learned = "block"
        found.append((host, path, rule, ruled or learned, name))
    return found


def deep_rows():
    """Variable places five segments down, and places too small to be variable."""
    rows = [f"http://d.net/es/a/b/c/v{chr(97 + k)}x/end.html" for k in range(24)]
    rows += [f"http://d.net/en/a/b/c/w{chr(97 + k)}y/q/r" for k in range(24)]
    rows += [f"http://d.net/en/a/{c}/{c}/{c}/{c}/{c}" for c in "abc"]
    rows += [f"http://e.com/{'x/' * 40}{k}" for k in "pq"]
    rows += [f"http://e.com/es/{c}{c}/f/g" for c in "abcdefghijklmnopqrst"]
    return rows


@pytest.mark.parametrize("urls", [URLS * 2, learned_rows(), deep_rows(), URLS + learned_rows() + deep_rows()])
def test_verdicts_against_plain_loops(spark, urls):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = urlfilter.judge(pages, URL_RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict, r.template) for r in found] == plain_verdicts(urls)


def test_given_pages_against_plain_loops(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").orderBy("page_id").collect()
    found = QUERIES["op4_urls"](spark, SF_DIR).orderBy("page_id").collect()
    expected = plain_verdicts([r.url for r in pages])
    assert [(r.host, r.path, r.rule, r.verdict, r.template) for r in found] == expected


def test_empty_table_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/1")], "page_id long, url string")
    assert urlfilter.judge(pages.filter(F.lit(False)), URL_RULES).isEmpty()
    row = urlfilter.judge(pages, []).collect()[0]
    assert (row.rule, row.verdict) == (None, "allow")


def test_no_python_on_the_main_path(spark):
    plan = QUERIES["op4_urls"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
