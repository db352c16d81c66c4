import re

import duckdb
import pytest

from quillwork.llm import url_filters as uf
from tests.llm.helpers import rows


def run(spark, urls, extra=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    return df, rows(uf.judge(df)).sort_values("page_id").reset_index(drop=True)


def test_parts_and_rules(spark):
    urls = [
        None, "", "nothing", "http://", "HTTP://A.COM", "http://x.COM/en/1?q#f", "http://com/en/", "http://notcom/en/1", "https://m.example.com/en/7x", "http://example.com/en/8",
        "https://a.net/de/1", "https://example.net/de/8", "https://a.example.net/de/88", "http://b.org/es/?x", "http://b.org/es", "a://b?c/d", "x://h#f", "http://É.com/en/9", "http://h/p\nq/r",
    ]
    _, got = run(spark, urls, extra=("host", "path", "rule", "g0", "t0", "tail", "b", "m", "n"))

    def expected(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for _, r in uf.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return host, path, max(fits, key=len) if fits else None

    verdict = {r: v for v, r in uf.RULES}
    assert len(got) == len(urls)
    for url, row in zip(urls, got.itertuples(), strict=True):
        host, path, rule = expected(url)
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict[rule] if rule else row.verdict in ("allow", "block")


def test_templates_learn_from_rules(spark):
    """Unruled pages are blocked where like branches are, and allowed elsewhere."""
    urls = [f"http://spam.com/en/{i}" for i in range(40)] + [f"http://spam.com/fr/{i}" for i in range(9)]
    urls += [f"http://wide.com/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}x/y" for i in range(60)]
    urls += [f"http://fine.net/de/{i}" for i in range(1, 30)] + [f"http://fine.net/fr/{i}" for i in range(9)]
    urls += [f"http://two.com/en/{i}" for i in range(60)] + [f"http://two.com/shop/item/{i}/buy" for i in range(20)] + ["http://two.com/about"]
    _, got = run(spark, urls)
    template, verdict = dict(zip(urls, got.template, strict=True)), dict(zip(urls, got.verdict, strict=True))
    assert template["http://spam.com/en/3"] == template["http://spam.com/fr/3"] == "*/#//"
    assert template["http://wide.com/akx/y"] == "*/y//" and verdict["http://wide.com/akx/y"] == "allow"
    assert verdict["http://spam.com/en/3"] == verdict["http://spam.com/fr/3"] == "block"
    assert verdict["http://fine.net/fr/3"] == "allow" and template["http://fine.net/fr/3"] == "*/#//"
    assert template["http://two.com/shop/item/3/buy"] == "shop/item/#/buy" and verdict["http://two.com/about"] == "block"  # inherited


def test_deep_paths_are_generalised(spark):
    urls = [f"http://deep.org/a/b/c/{x}{y}/{y}{x}/{x}" for x in "klmnopqr" for y in "stuvwx"]
    _, got = run(spark, urls)
    assert set(got.template) == {"a/b/c/*"} and set(got.verdict) == {"allow"}


def test_branches_of_unlike_rates_stay_apart(spark):
    rules = (("block", "h.com/bad/"), ("allow", "h.com/good/"))
    from pyspark.sql import functions as F

    urls = [f"http://h.com/{k}/{i}" for k in ("bad", "good", "new") for i in range(40)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.host + "/" + r.template: r.verdict for r in uf.judge(df, rules=rules).select("host", "template", "verdict").distinct().orderBy(F.desc("verdict")).collect()}
    assert got["h.com/bad/#//"] == "block" and got["h.com/good/#//"] == "allow"


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "http://a.com/en/1"), (None, "http://a.com/en/1"), (1, None), (1, None)], "page_id long, url string")
    got = rows(uf.judge(df))
    assert len(got) == 4 and got.page_id.isna().sum() == 2 and set(got[got.page_id.isna()].verdict) == {"block"}


def test_purity_decides_pages_without_a_rule(spark):
    got = rows(uf.op10_url_filters(spark, "/root/testdata/sf0.1"))
    free = got[got.rule.isna()]
    assert set(free.verdict) == {"allow", "block"}
    assert ((free.purity >= uf.PURITY) == (free.verdict == "block")).all()


@pytest.mark.parametrize("level", ["0.001", "0.01"])
def test_sql_agrees(spark, level):
    sf = f"/root/testdata/sf{level}"
    got = rows(uf.op10_url_filters(spark, sf)).sort_values("page_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(uf.SQL).df().sort_values("page_id").reset_index(drop=True)
    for c in ("page_id", "host", "path", "template", "purity", "verdict"):
        assert got[c].tolist() == want[c].tolist()


def test_sql_agrees_on_a_mixed_table(spark):
    urls = [f"http://h{i % 3}.example.{'com' if i % 2 else 'net'}/{['en', 'de', 'fr', 'a' + chr(97 + i % 26) + chr(97 + i // 26 % 26)][i % 4]}/{i * 7 % 100}{['', '.html', '/x/y/z'][i % 3]}" for i in range(600)] + [None, "x"]
    df, got = run(spark, urls)
    con = duckdb.connect()
    pages = df.toPandas()
    con.register("pages", pages)
    want = con.execute(uf.SQL).df().sort_values("page_id").reset_index(drop=True)
    assert got.verdict.tolist() == want.verdict.tolist() and got.template.tolist() == want.template.tolist()


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert rows(uf.judge(df)).empty
