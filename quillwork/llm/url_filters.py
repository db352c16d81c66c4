"""URL filters: fixed host/path rules, then a path-template tree judged by labelled purity.

The pages that a rule decides are the labels of the tree. Per host, path segments are generalised:
digit runs become #, a level with more than WIDE children becomes *, and sibling branches that do
not differ statistically are merged into *. Two things are compared by two-proportion tests, each
branch against all its siblings: how many of its pages have the shape in question below it, and its
labelled block rate, where both sides have LEAST labels. A branch with too few labels is merged by
what lies below it alone; a leaf without labels has nothing to compare and stays. The first three
segments are a level each; all that follow are the fourth.

A template is rejected when its block rate reaches PURITY. The rate is smoothed towards the rate of
the rest of its branch (pages with the same first segment), that towards the rest of its host, and
that towards the rate of all labels, but no higher than one half: without labels of its own, a
template inherits from its branch and host, and a host without labels is never rejected.

Only DataFrame functions run here. Pages are combined into templates before any shuffle, so a
host with a third of all pages is as many rows as it has templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm._shared import cut, table

#: (verdict, host/path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Single segments of a template; whatever follows them is one more level.
SINGLE = 3
WIDE = 32
LEAST = 5
Z2 = 3.84
PRIOR = 5
PURITY = 0.8

_G = [f"g{i}" for i in range(SINGLE + 1)]
_T = [f"t{i}" for i in range(SINGLE + 1)]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as host/path; of equally long ones the first."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, rule).otherwise(found)
    return found


def _like(a: Column, of_a: Column, b: Column, of_b: Column) -> Column:
    """Whether the shares a/of_a and b/of_b do not differ by a two-proportion test; of_a and of_b are at least 1."""
    p = (a + b) / (of_a + of_b)
    gap = a / of_a - b / of_b
    return gap * gap <= F.lit(Z2) * p * (1 - p) * (1 / of_a + 1 / of_b)


def merged(tree: DataFrame, level: int) -> DataFrame:
    """The tree with like sibling branches of a level as *."""
    g, parent, below = _G[level], ["host", *_G[:level]], _G[level + 1 :]
    leaf = tree.where(F.col(g) != "").groupBy(*parent, g, *below).agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("m").alias("m"))
    branch = leaf.groupBy(*parent, g).agg(F.sum("n").alias("bn"))
    family = branch.groupBy(*parent).agg(F.sum("bn").alias("fn"))
    around = leaf.groupBy(*parent, *below).agg(F.sum("n").alias("an"), F.sum("b").alias("ab"), F.sum("m").alias("am"))
    all_of = leaf.join(branch, [*parent, g]).join(family, parent).join(around, [*parent, *below])
    c = F.col
    shaped = (c("bn") >= LEAST) & (c("fn") - c("bn") >= LEAST) & _like(c("n"), c("bn"), c("an") - c("n"), F.greatest(c("fn") - c("bn"), F.lit(1)))
    known = (c("m") >= LEAST) & (c("am") - c("m") >= LEAST)
    rated = _like(c("b"), F.greatest(c("m"), F.lit(1)), c("ab") - c("b"), F.greatest(c("am") - c("m"), F.lit(1)))
    inner = F.lit(False) if not below else c(below[0]) != ""
    alike = all_of.where(shaped & F.when(known, rated).otherwise(inner)).select(*parent, g, *below, F.lit(True).alias("alike"))
    return tree.join(alike, [*parent, g, *below], "left").withColumn(g, F.when(F.col("alike"), "*").otherwise(F.col(g))).drop("alike")


def templates(pages: DataFrame) -> DataFrame:
    """One row per host and lexical path shape t* with its template g*, pages n and labels b of m.

    Every level reads the tree several times, so each is written once; a tree has as many rows as shapes."""
    shapes = pages.groupBy("host", *_T).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == "block").alias("b"),
        F.count("label").alias("m"),
    )
    tree = cut(shapes.select("*", *[F.col(t).alias(g) for t, g in zip(_T, _G, strict=True)]), "tree")
    for level, g in enumerate(_G):
        parent = ["host", *_G[:level]]
        wide = (
            tree.where(F.col(g) != "").groupBy(*parent, g).agg(F.lit(1).alias("one"))
            .groupBy(*parent).agg(F.count(F.lit(1)).alias("children")).where(F.col("children") > WIDE)
            .select(*parent, F.lit(True).alias("wide"))
        )
        tree = cut(tree.join(wide, parent, "left").withColumn(g, F.when(F.col("wide") & (F.col(g) != ""), "*").otherwise(F.col(g))).drop("wide"), "tree")
    for level in range(len(_G)):
        tree = cut(merged(tree, level), "tree")
    return tree


def purities(tree: DataFrame) -> DataFrame:
    """host, g* and the smoothed block rate of every template."""
    found = cut(tree.groupBy("host", *_G).agg(F.sum("b").alias("b"), F.sum("m").alias("m")), "templates")
    branches = found.groupBy("host", "g0").agg(F.sum("b").alias("bb"), F.sum("m").alias("bm"))
    hosts = found.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("m").alias("hm"))
    totals = hosts.agg(F.coalesce(F.sum("hb"), F.lit(0)).alias("b"), F.coalesce(F.sum("hm"), F.lit(0)).alias("m")).first()
    root = min(0.5, (totals.b + PRIOR * 0.5) / (totals.m + PRIOR))
    c = F.col
    host = (c("hb") - c("bb") + PRIOR * F.lit(root)) / (c("hm") - c("bm") + PRIOR)
    branch = (c("bb") - c("b") + PRIOR * host) / (c("bm") - c("m") + PRIOR)
    purity = (c("b") + PRIOR * branch) / (c("m") + PRIOR)
    return found.join(branches, ["host", "g0"]).join(hosts, "host").select("host", *_G, purity.alias("purity"))


def judge(pages: DataFrame, url_col: str = "url", id_col: str = "page_id", rules: tuple = RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, template, purity, verdict.

    A null url, or one without ://, has an empty host and path, fits no rule, and is judged as the
    template of the empty host. Urls of any length and depth are read whole. Null ids stay null and
    repeated rows get a row each, and count as often in their template; an empty table gives an empty
    result; other columns are never read."""
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    verdicts = F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)])
    segments = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn(
        "s", F.array_remove(F.split(F.regexp_replace("path", "[0-9]+", "#"), "/"), "")
    )
    shaped = segments.select(
        "page_id", "host", "path", "rule", verdicts[F.col("rule")].alias("label"),
        *[F.coalesce(F.get("s", F.lit(i)), F.lit("")).alias(t) for i, t in enumerate(_T[:-1])],
        F.array_join(F.slice("s", SINGLE + 1, F.greatest(F.size("s") - SINGLE, F.lit(0))), "/").alias(_T[-1]),
    )
    tree = templates(shaped)
    named = tree.join(purities(tree), ["host", *_G]).select("host", *_T, F.concat_ws("/", *_G).alias("template"), "purity")
    return shaped.join(named, ["host", *_T]).select(
        "page_id", "host", "path", "rule", "template", F.round("purity", 9).alias("purity"),
        F.coalesce("label", F.when(F.col("purity") >= PURITY, "block").otherwise("allow")).alias("verdict"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    rules = "\n".join(
        f"           WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'"
        for _, r in sorted(RULES, key=lambda r: -len(r[1]))
        for h, _, p in [r.partition("/")]
    )
    blocks = ", ".join(f"'{r}'" for v, r in RULES if v == "block")
    at, keys = "tree0", ", ".join(_T)
    steps = []
    like = lambda a, of_a, b, of_b: (
        f"power({a} / {of_a} - {b} / {of_b}, 2) <= {Z2}::DOUBLE * (({a} + {b}) / ({of_a} + {of_b})) * (1 - ({a} + {b}) / ({of_a} + {of_b})) * (1 / {of_a} + 1 / {of_b})"
    )
    for level, g in enumerate(_G):
        parent = ", ".join(["host", *_G[:level]])
        rest = ", ".join(x for x in _G if x != g)
        steps.append(
            f"w{level} AS (SELECT {parent} FROM {at} WHERE {g} <> '' GROUP BY {parent} HAVING count(DISTINCT {g}) > {WIDE}),\n"
            f"tree{level + 1} AS (SELECT host, {keys}, n, b, m, {rest}, CASE WHEN {g} <> '' AND ({parent}) IN (SELECT ({parent}) FROM w{level}) THEN '*' ELSE {g} END AS {g} FROM {at})"
        )
        at = f"tree{level + 1}"
    for level, g in enumerate(_G):
        rest = ", ".join(x for x in _G if x != g)
        parent, around = ", ".join(["host", *_G[:level]]), f"host, {rest}"
        inner = "false" if level == SINGLE else f"{_G[level + 1]} <> ''"
        rated = like("b", "greatest(m, 1)", "(ab - b)", "greatest(am - m, 1)")
        steps.append(
            f"leaf_{g} AS (SELECT {around}, {g}, sum(n) AS n, sum(b) AS b, sum(m) AS m FROM {at} WHERE {g} <> '' GROUP BY ALL),\n"
            f"fam_{g} AS (SELECT *, sum(n) OVER (PARTITION BY {parent}, {g}) AS bn, sum(n) OVER (PARTITION BY {parent}) AS fn, sum(n) OVER w AS an, sum(b) OVER w AS ab, sum(m) OVER w AS am"
            f" FROM leaf_{g} WINDOW w AS (PARTITION BY {around})),\n"
            f"like_{g} AS (SELECT {around}, {g}, true AS alike FROM fam_{g} WHERE bn >= {LEAST} AND fn - bn >= {LEAST} AND {like('n', 'bn', '(an - n)', 'greatest(fn - bn, 1)')}\n"
            f"  AND CASE WHEN m >= {LEAST} AND am - m >= {LEAST} THEN {rated} ELSE {inner} END),\n"
            f"m_{g} AS (SELECT host, {keys}, n, b, m, {rest}, CASE WHEN alike THEN '*' ELSE {g} END AS {g} FROM {at} LEFT JOIN like_{g} USING ({around}, {g}))"
        )
        at = f"m_{g}"
    gs = ", ".join(_G)
    return rf"""
WITH p0 AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p1 AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p0),
p2 AS (
  SELECT *, CASE
{rules} END AS rule,
         list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> '') AS s FROM p1),
p AS (
  SELECT page_id, host, path, rule, CASE WHEN rule IN ({blocks}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS label,
         {", ".join(f"coalesce(s[{i + 1}], '') AS {t}" for i, t in enumerate(_T[:-1]))}, array_to_string(s[{SINGLE + 1}:], '/') AS {_T[-1]} FROM p2),
tree0 AS (
  SELECT host, {keys}, count(*) AS n, count(*) FILTER (label = 'block') AS b, count(label) AS m,
         {", ".join(f"{t} AS {g}" for t, g in zip(_T, _G, strict=True))} FROM p GROUP BY host, {keys}),
{(", " + chr(10)).join(steps)},
found AS (SELECT host, {gs}, sum(b) AS b, sum(m) AS m FROM {at} GROUP BY ALL),
root AS (SELECT least(0.5::DOUBLE, (coalesce(sum(b), 0) + {PRIOR} * 0.5::DOUBLE) / (coalesce(sum(m), 0) + {PRIOR})) AS root FROM found),
summed AS (
  SELECT *, sum(b) OVER (PARTITION BY host, g0) AS bb, sum(m) OVER (PARTITION BY host, g0) AS bm, sum(b) OVER (PARTITION BY host) AS hb, sum(m) OVER (PARTITION BY host) AS hm FROM found),
judged AS (
  SELECT host, {gs}, (b + {PRIOR} * ((bb - b + {PRIOR} * ((hb - bb + {PRIOR} * root) / (hm - bm + {PRIOR}))) / (bm - m + {PRIOR}))) / (m + {PRIOR}) AS purity FROM summed, root),
named AS (
  SELECT host, {keys}, concat_ws('/', {gs}) AS template, purity FROM {at} JOIN judged USING (host, {gs}))
SELECT page_id, host, path, rule, template, round(purity, 9) AS purity, coalesce(label, CASE WHEN purity >= {PURITY}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN named USING (host, {keys})
"""


SQL = _sql()
