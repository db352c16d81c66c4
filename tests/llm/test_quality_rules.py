import re
from collections import defaultdict

import duckdb

from quillwork.llm import quality_rules as qr
from tests.llm.helpers import awkward, awkward_rows, empty, prose, rows, table

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs: list[tuple], min_docs=qr.MIN_DOCS, min_share=qr.MIN_SHARE) -> list[tuple]:
    holders, hosts = defaultdict(set), defaultdict(set)
    lines_of = []
    for _, text, source in docs:
        text, host = text or "", source or ""
        lines = [x for x in text.split("\n") if _WORD.search(x)]
        lines_of.append([(host, " ".join(_WORD.findall(x)).lower()) for x in lines])
        hosts[host].add(text)
        for key in lines_of[-1]:
            holders[key].add(text)
    bad = {k for k, v in holders.items() if len(v) >= min_docs and len(v) * min_share >= len(hosts[k[0]])}
    out = []
    for (doc_id, text, _), keys in zip(docs, lines_of, strict=True):
        text = text or ""
        words = _WORD.findall(text)
        windows = defaultdict(list)
        for i in range(len(words) - 2):
            windows[tuple(words[i : i + 3])].append(i)
        covered = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(3)}
        lines = [x for x in text.split("\n") if _WORD.search(x)]
        removed = sum(len(k[1].split(" ")) for k in keys if k in bad)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        kept = not failed and not (len(words) - removed) * 10 < len(words) * qr.KEEP_TENTHS
        out.append((-1 if doc_id is None else doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, removed, kept))
    return sorted(out)


def plain(got):
    return sorted((-1 if r[0] is None or r[0] != r[0] else int(r[0]), *map(int, r[1:6]), bool(r[6]), int(r[7]), bool(r[8])) for r in got[
        ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"]].itertuples(index=False))


def test_awkward(spark):
    got = rows(qr.quality(awkward(spark)))
    assert plain(got) == brute([(r[0], r[1], r[3]) for r in awkward_rows()])
    assert rows(qr.quality(empty(spark))).empty


def test_whole_table_and_sql(spark, sf):
    docs = table(sf, "documents")
    got = rows(qr.op6_quality_rules(spark, sf))
    assert plain(got) == brute(list(zip(docs.doc_id.tolist(), docs.text, docs.source, strict=True)))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert plain(con.execute(qr.SQL).df()) == plain(got)


def test_depleted_documents_go_and_copies_do_not_count(spark):
    banner = "\n".join(f"Subscribe now to block {i} of the boilerplate that every page of this host repeats in full" for i in range(12))
    docs = [(i, f"{banner}\nown words {i}", "h") for i in range(30)] + [(100 + i, prose(i, 90), "h") for i in range(30)] + [(200 + i, prose(500, 90), "h") for i in range(40)]
    got = rows(qr.quality(spark.createDataFrame(docs, "doc_id long, text string, source string")))
    assert plain(got) == brute(docs)
    kept = set(got[got.kept].doc_id)
    assert kept == set(range(100, 130)) | set(range(200, 240))


def test_boilerplate_lines_leave_the_pipeline_texts(spark):
    """Kept documents lose the lines above the limits, under the hosts that have them only; n_chars follows."""
    import corpus_pipeline as cp

    banner = "Accept  all cookies to read on"
    docs = [(i, f"{banner}\n{prose(i, 60)}\n\n{banner.upper()} \n{prose(i + 50, 30)}", "h", 7) for i in range(25)]
    docs += [(None, docs[0][1], "h", 7), (0, docs[0][1], "other", 7), (99, prose(99, 60), "h", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long")
    got = sorted(map(tuple, cp.quality(spark, df, "").collect()), key=repr)
    own = {i: f"{prose(i, 60)}\n\n{prose(i + 50, 30)}" for i in range(25)}
    expected = [(i, own[i or 0], h, len(own[i or 0])) if h == "h" and i != 99 else (i, t, h, n) for i, t, h, n in docs]
    assert got == sorted(expected, key=repr)


def test_limits_fire_alike_at_every_size(spark):
    """A line in 3 of 100 texts goes and one in 1 of 100 stays, in small and large hosts."""
    docs = []
    for host, n in (("small", 200), ("large", 2000)):
        for i in range(n):
            lines = [f"own line {host} {i} {prose(i, 60)}"]
            lines += ["Share this page with your friends"] if i % 100 < 3 else []
            lines += ["Now a line that few pages hold"] if i % 100 == 9 else []
            docs.append((len(docs), "\n".join(lines), host))
    got = rows(qr.quality(spark.createDataFrame(docs, "doc_id long, text string, source string")))
    assert plain(got) == brute(docs)
    touched = got[got.removed_words > 0].groupby("host").size().to_dict()
    assert touched == {"small": 6, "large": 60}
