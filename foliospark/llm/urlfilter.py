"""URL filters by a tree of path templates for each host.

Rules name a host with its subdomains and the beginning of a path; the longest
that fits decides. Its verdicts are also the labels from which the method learns
to judge the other pages:

1. Paths are cut into segments and walked level by level. A segment with a digit,
   or at a place of the tree where most pages differ, is generalised to a wildcard
   that keeps its file extension. A place with fewer different paths than a variable
   one needs has none below it: its paths are finished at once, so that the walk ends
   with the deepest place that may be variable.
2. Leaves below one first segment are merged into one branch while their share
   of blocked pages is statistically the same as that of the leaves together, and
   first segments of a host in the same way, if they hold labelled pages at all.
3. A template's purity is its share of blocked pages among labelled ones, smoothed
   towards the share of the whole table. From ``REJECTED_PURITY`` on its pages
   are blocked, else allowed.

Everything is SQL: the same text, with the few functions that are named
differently, runs on Spark and states the expected result for another engine.
Counts are taken over distinct paths after map-side aggregation; joins on a hot
host carry a few rows per host on one side.

Defined results: a null url, or one without "://", has an empty host and path,
fits no rule and is allowed unless learned otherwise. An empty path is the tree's
root. Repeated rows count and are judged one by one. Without labelled pages nothing
is rejected. An empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.session import materialise

STATED_LEVELS = 8  # that the stated SQL walks; below, no given place is variable
VARIABLE_DISTINCT = 10  # different segments at a place that may be variable
VARIABLE_SHARE = 0.5  # of the pages there
SMOOTHING = 5.0
REJECTED_PURITY = 0.9
SIMILAR_DEVIATIONS = 1.96

Rule = tuple[str, str]  # verdict and host/path, as in ("block", "net/es/")

STEP = "[^/]+/+"  # a segment and the slashes after it
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_cases(rules: list[Rule], then: str) -> str:
    """CASE over the rules, longest first; ``then`` picks rule or verdict."""
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        path = "/" + path
        cases.append(
            f"WHEN (host = {quoted(host)} OR right(host, {len(host) + 1}) = {quoted('.' + host)})"
            f" AND left(path, {len(path)}) = {quoted(path)}"
            f" THEN {quoted(rule if then == 'rule' else verdict)}"
        )
    return f"CASE {' '.join(cases)} END" if cases else "CAST(NULL AS {string})"


def located_sql(source: str, key: str, url: str, rules: list[Rule]) -> str:
    """Host, path, fitting rule and its verdict of every row."""
    return f"""
SELECT page, host, path, {rule_cases(rules, "rule")} AS rule,
       {rule_cases(rules, "verdict")} AS ruled
FROM (SELECT page,
             translate(regexp_extract(after, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
             regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path
      FROM (SELECT {key} AS page,
                   CASE WHEN instr({url}, '://') > 0
                        THEN substr({url}, instr({url}, '://') + 3) ELSE '' END AS after
            FROM {source}) AS cut) AS parts"""


def paths_sql(source: str) -> str:
    """Pages, labelled pages and blocked pages of each distinct path, none of it walked yet."""
    return f"""
SELECT host, path, '' AS t, '' AS t1, count(*) AS n, count(ruled) AS labelled,
       count(CASE WHEN ruled = 'block' THEN 1 END) AS blocked
FROM {source} GROUP BY host, path"""


def wildcard(segment: str, variable: str) -> str:
    return (
        f"CASE WHEN regexp_extract({segment}, '[0-9]', 0) <> '' OR {variable}"
        f" THEN concat('*', regexp_extract({segment}, '[.][A-Za-z]+$', 0)) ELSE {segment} END"
    )


def level_sql(source: str, level: int) -> str:
    """Add segment ``level`` to the templates ``t``; ``state`` says how a path goes on.

    Paths are ``ended`` without a segment there, ``closed`` where the place has too few
    different ones to be variable there or below, and else ``open``.
    """
    segment = f"regexp_extract(path, '^/*{STEP * (level - 1)}([^/]+)', 1)"
    variable = f"v.different >= {VARIABLE_DISTINCT} AND v.different >= {VARIABLE_SHARE} * v.pages"
    first = f"CASE WHEN p.s = '' THEN '' ELSE {wildcard('p.s', variable)} END" if level == 1 else "p.t1"
    return f"""
SELECT p.host, p.path, p.n, p.labelled, p.blocked, {first} AS t1, p.t AS above,
       CASE WHEN p.s = '' THEN p.t ELSE concat(p.t, '/', {wildcard('p.s', variable)}) END AS t,
       CASE WHEN p.s = '' THEN 'ended' WHEN v.further < {VARIABLE_DISTINCT} THEN 'closed'
            ELSE 'open' END AS state
FROM (SELECT *, {segment} AS s FROM {source}) AS p
JOIN (SELECT host, t, count(*) AS different, sum(n) AS pages, sum(further) AS further
      FROM (SELECT host, t, s, sum(n) AS n, count(CASE WHEN s <> '' THEN 1 END) AS further
            FROM (SELECT *, {segment} AS s FROM {source}) AS cut
            GROUP BY host, t, s) AS each_one
      GROUP BY host, t) AS v ON p.host = v.host AND p.t = v.t"""


def finished_sql(source: str, level: int, above: str, functions: tuple[str, ...]) -> str:
    """Whole templates: ``above`` and all segments from ``level`` on, told by their digits.

    ``functions`` cut a text at slashes, filter and transform a list by a lambda, join a
    list, and begin a lambda.
    """
    cut, keep, each, join, head = functions
    rest = f"regexp_extract(path, '(?s)^/*{STEP * (level - 1)}(.*)$', 1)"
    parts = f"{keep}({cut}({rest}, '/'), {head} x <> '')"
    joined = f"{join}({each}({parts}, {head} {wildcard('x', 'FALSE')}), '/')"
    return f"""
SELECT host, path, n, labelled, blocked, t1,
       CASE WHEN rest = '' THEN {above} ELSE concat({above}, '/', rest) END AS t
FROM (SELECT *, {joined} AS rest FROM {source}) AS cut"""


SPARK_LISTS = ("split", "filter", "transform", "array_join", "x ->")
STATED_LISTS = ("string_split", "list_filter", "list_transform", "array_to_string", "lambda x:")


def similar(b: str, n: str, pool_b: str, pool_n: str) -> str:
    """Whether b of n is as many as the pool's share lets expect."""
    share = f"(CAST({pool_b} AS DOUBLE) / nullif({pool_n}, 0))"
    return (
        f"abs({b} - {n} * {share}) <= 0.5 + {SIMILAR_DEVIATIONS} *"
        f" sqrt({n} * {share} * (1 - {share}))"
    )


def templates_sql(source: str) -> str:
    """Each distinct path with the template it belongs to and its verdict."""
    leaf = "host, t1, t"
    return f"""
WITH leaves AS (
  SELECT {leaf}, sum(labelled) AS l, sum(blocked) AS b FROM {source} GROUP BY {leaf}),
branches AS (
  SELECT host, t1, sum(l) AS l, sum(b) AS b FROM leaves GROUP BY host, t1),
hosts AS (
  SELECT host, sum(l) AS l, sum(b) AS b FROM branches GROUP BY host),
total AS (SELECT sum(l) AS l, sum(b) AS b FROM hosts),
joined AS (
  SELECT x.host, x.t1, x.l, x.b,
         x.l > 0 AND {similar("x.b", "x.l", "h.b", "h.l")} AS joins
  FROM branches AS x JOIN hosts AS h ON x.host = h.host),
pooled AS (
  SELECT host, sum(l) AS l, sum(b) AS b FROM joined WHERE joins GROUP BY host),
placed AS (
  SELECT y.host, y.t1, y.t, y.l, y.b,
         CASE WHEN j.l = 0 THEN FALSE
              ELSE {similar("y.b", "y.l", "j.b", "j.l")} END AS joins,
         j.joins AS above, j.l AS branch_l, j.b AS branch_b
  FROM leaves AS y JOIN joined AS j ON y.host = j.host AND y.t1 = j.t1),
judged AS (
  SELECT d.host, d.t1, d.t,
         CASE WHEN d.joins AND d.above THEN concat(d.host, '/')
              WHEN d.joins THEN concat(d.host, '/', d.t1, '/')
              ELSE concat(d.host, CASE WHEN d.t = '' THEN '/' ELSE d.t END) END AS template,
         CASE WHEN d.joins AND d.above THEN q.l WHEN d.joins THEN d.branch_l ELSE d.l END AS l,
         CASE WHEN d.joins AND d.above THEN q.b WHEN d.joins THEN d.branch_b ELSE d.b END AS b
  FROM placed AS d LEFT JOIN pooled AS q ON d.host = q.host)
SELECT p.host, p.path, g.template,
       CASE WHEN g.l > 0 AND (g.b + {SMOOTHING} * (SELECT CAST(b AS DOUBLE) / l FROM total WHERE l > 0))
                 / (g.l + {SMOOTHING}) >= {REJECTED_PURITY}
            THEN 'block' ELSE 'allow' END AS verdict
FROM {source} AS p
JOIN judged AS g ON p.host = g.host AND p.t1 = g.t1 AND p.t = g.t"""


def verdicts_sql(located: str, templates: str, key: str) -> str:
    return f"""
SELECT l.page AS {key}, l.host, l.path, l.rule, coalesce(l.ruled, t.verdict) AS verdict, t.template
FROM {located} AS l JOIN {templates} AS t ON l.host = t.host AND l.path = t.path"""


def walk(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Every path with its template, walked as long as a place may be variable."""
    finished, level = None, 1
    while True:
        at = materialise(spark.sql(level_sql("{paths}", level), paths=paths), "paths")
        ends = at.filter("state = 'ended'").select(*WALKED)
        closed = finished_sql("{rows}", level, "above", SPARK_LISTS)
        ends = ends.unionByName(spark.sql(closed, rows=at.filter("state = 'closed'")))
        finished = ends if finished is None else finished.unionByName(ends)
        paths = at.filter("state = 'open'").select(*WALKED)
        if paths.isEmpty():
            return finished
        level += 1


WALKED = ("host", "path", "n", "labelled", "blocked", "t1", "t")


def judge(
    pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url"
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``template`` of every page."""
    spark = pages.sparkSession
    rows = pages.selectExpr(f"`{key}` AS page_key", f"`{url}` AS page_url")
    sql = located_sql("{rows}", "page_key", "page_url", rules).replace("{string}", "STRING")
    located = spark.sql(sql, rows=rows)
    paths = materialise(spark.sql(paths_sql("{located}"), located=located), "paths")
    walked = walk(spark, paths)
    templates = spark.sql(templates_sql("{paths}"), paths=materialise(walked, "paths"))
    return spark.sql(
        verdicts_sql("{located}", "{templates}", f"`{key}`"), located=located, templates=templates
    )


def oracle_sql(rules: list[Rule], source: str = "pages", key: str = "page_id", url: str = "url") -> str:
    """The same result as one statement of standard SQL."""
    steps = [
        ("located", located_sql(source, key, url, rules).replace("{string}", "VARCHAR")),
        ("paths0", paths_sql("located")),
    ]
    for level in range(1, STATED_LEVELS + 1):
        steps.append((f"paths{level}", level_sql(f"paths{level - 1}", level)))
    whole = finished_sql(f"paths{STATED_LEVELS}", STATED_LEVELS + 1, "t", STATED_LISTS)
    steps += [("whole", whole), ("templates", templates_sql("whole"))]
    head = ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in steps)
    return f"WITH {head}{verdicts_sql('located', 'templates', key)}"
