import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillwork.llm import near_dedup, pii, quality_rules
from tests.llm.helpers import awkward, awkward_rows, empty, rows, table
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_near_dedup import brute_classes
from tests.llm.test_quality_rules import brute as quality_brute


def test_stages():
    assert [n for n, _ in cp.STAGES] == ["quality", "exact", "near", "personal_data", "packed"]


def test_whole_table_against_brute_force(spark, sf):
    docs = table(sf, "documents").to_dict("records")
    left = spark.read.parquet(f"{sf}/documents.parquet")
    columns = left.columns

    def step(stage):
        nonlocal left
        out = stage(spark, left, sf)
        assert out.columns == columns
        left = spark.createDataFrame(out.toPandas(), left.schema)
        return left.toPandas()

    verdicts = {r[0]: r[-1] for r in quality_brute([(d["doc_id"], d["text"], d["source"]) for d in docs])}
    docs = [d for d in docs if verdicts[d["doc_id"]]]
    assert sorted(step(cp.quality).doc_id) == sorted(d["doc_id"] for d in docs)

    keep = {r[1] for r in exact_brute([(d["doc_id"], d["text"]) for d in docs])}
    docs = [d for d in docs if d["doc_id"] in keep]
    assert sorted(step(cp.exact).doc_id) == sorted(keep)

    first = {}
    for i, c in brute_classes([(d["doc_id"], d["text"]) for d in docs]).items():
        first[c] = min(first.get(c, docs[i]["doc_id"]), docs[i]["doc_id"])
    docs = [d for d in docs if d["doc_id"] in set(first.values())]
    assert sorted(step(cp.near).doc_id) == sorted(first.values())

    weights = pii.trained()
    clean = {d["doc_id"]: pii.redacted(d["text"], weights) for d in docs}
    got = step(cp.personal_data)
    assert dict(zip(got.doc_id, got.text, strict=True)) == clean and (got.n_chars == got.text.str.len()).all()

    pieces = rows(cp.run(spark, sf))
    assert set(pieces.doc_id) == set(clean)
    assert pieces.groupby("doc_id").length.sum().to_dict() == pieces.groupby("doc_id").doc_tokens.first().to_dict()


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_awkward_and_empty(spark, sf, name):
    stage = dict(cp.STAGES)[name]
    docs = awkward(spark)
    got, n = rows(stage(spark, docs, sf)), len(awkward_rows())
    if name == "packed":
        assert got.length.sum() > n
    else:
        assert list(got.columns) == docs.columns
        if name == "quality":
            assert len(got) == sum(r[-1] for r in quality_brute([(r[0], r[1], r[3]) for r in awkward_rows()]))
        elif name == "exact":
            assert len(got) == len({r[3] for r in exact_brute([r[:2] for r in awkward_rows()])})
        elif name == "near":
            assert len(got) == len(set(brute_classes([r[:2] for r in awkward_rows()]).values()))
        else:
            assert len(got) == n and got.text.isna().sum() == 2
    assert rows(stage(spark, empty(spark), sf)).empty


def test_columns_of_any_name_and_repeated_rows(spark, sf):
    """Names that the stages use themselves stay as they are; one of many repeated rows is kept."""
    names = ["row", "own_id", "own_text", "own_sig", "clean", "text_key", "kept", "n", "sig", "host", "removed_lines", "_quill_id", "_quill_text"]
    one = spark.createDataFrame(awkward_rows()[:4] + [awkward_rows()[3]] * 40 + [awkward_rows()[8]] * 40, empty(spark).select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = one.select("*", *[F.lit(f"v{n}").alias(n) for n in names])
    for stage in (cp.quality, cp.exact, cp.near):
        got = rows(stage(spark, docs, sf))
        assert list(got.columns) == docs.columns and len(got) >= 1
        assert all(set(got[n]) == {f"v{n}"} for n in names)
    assert len(rows(cp.exact(spark, docs, sf))) == 2


def test_each_stage_calls_its_operator(spark, monkeypatch, sf):
    seen = []
    for module, name in ((quality_rules, "quality"), (near_dedup, "near_duplicates")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, real=real, name=name, **k: (seen.append(name), real(*a, **k))[1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") < 30)
    cp.quality(spark, docs, sf)
    cp.near(spark, docs, sf)
    assert seen == ["quality", "near_duplicates"]
