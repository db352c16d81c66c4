"""Audits, gates, corroboration, reconstruction and resampling beyond what the registered queries hold against SQL."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillwork.functions import contracts, reference
from quillwork.functions import validation as va
from quillwork.functions import version as vs
from quillwork.operators import audit, reconstruction
from quillwork.operators import corroboration as co
from quillwork.operators import resampling as rs


def test_gate_names_what_was_found(spark):
    rows = spark.range(5).withColumn("panel", F.when(F.col("id") == 3, "test").otherwise("optimization"))
    none, bad = audit.violations(rows, {"never": F.lit(False)}, F.col("id")), audit.violations(rows, {"is_three": F.col("id") == 3, "unknown": F.lit(None).cast("boolean")}, F.col("id"))
    assert audit.gated(rows, none).count() == 5
    assert Counter(r.rule for r in bad.collect()) == {"is_three": 1, "unknown": 5}
    with pytest.raises(Exception, match="violated: is_three 3"):
        audit.gated(rows, bad).collect()
    listed = audit.violations(rows, {"is_three": F.col("id") == 3}, F.col("id"), raised=False)
    assert audit.gated(rows, listed).count() == 5
    assert audit.guarded(rows.where("id < 3"), "panel", "optimization").count() == 3
    with pytest.raises(Exception, match="only optimization may be read, not test"):
        audit.guarded(rows, "panel", "optimization").collect()
    with pytest.raises(Exception, match="only optimization"):
        audit.guarded(rows.withColumn("panel", F.lit(None).cast("string")), "panel", "optimization").collect()


FIXTURE = "profile string, partition string, semantics string, components array<struct<vendor:string,product:string,version:string>>, advisories array<struct<id:string,vendor:string,product:string,exact:string,lower:string,upper:string,lower_inclusive:boolean,upper_inclusive:boolean>>, expected array<string>"


def fixture_rows():
    part = {"vendor": "v", "product": "p", "version": "1.2"}
    term = {"id": "CVE-2024-1000", "vendor": "V", "product": "P", "exact": None, "lower": "1.0", "upper": "1.2", "lower_inclusive": True, "upper_inclusive": True}
    return [
        {"profile": f"p_{i}", "partition": panel, "semantics": "v1", "components": [part], "advisories": [term | {"id": f"CVE-2024-100{i}"}], "expected": [f"CVE-2024-100{i}"]}
        for i, panel in enumerate(("optimization", "validation", "test"))
    ]


def loaded(spark, tmp_path, rows, name):
    path = tmp_path / f"{name}.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    read = spark.read.schema(FIXTURE).json(str(path))
    return read, audit.fixture_violations(read)


def test_a_good_fixture_is_read(spark, tmp_path):
    read, found = loaded(spark, tmp_path, fixture_rows(), "good")
    assert found.count() == 0 and audit.gated(read, found).count() == 3


@pytest.mark.parametrize(
    ("rule", "change"),
    [
        ("profile_id", lambda r: r[0].update(profile="P 0")), ("profile_twice", lambda r: r.append(dict(r[0]))), ("partition", lambda r: r[0].update(partition="other")),
        ("partition", lambda r: r[0].update(partition=None)), ("semantics", lambda r: r[0].update(semantics=None)), ("no_inputs", lambda r: r[0].update(components=[])),
        ("no_inputs", lambda r: r[0].update(advisories=None)), ("component_version", lambda r: r[0]["components"].append({"vendor": "v", "product": "x", "version": "1.02"})),
        ("candidate_twice", lambda r: r[0]["advisories"].append(dict(r[0]["advisories"][0]))), ("advisory_id", lambda r: r[0]["advisories"][0].update(id="CVE-24-1")),
        ("advisory_in_partitions", lambda r: r[0]["advisories"].append(dict(r[1]["advisories"][0]))), ("exact_and_range", lambda r: r[0]["advisories"][0].update(exact="1.2")),
        ("bound_version", lambda r: r[0]["advisories"][0].update(lower="one")), ("inclusivity", lambda r: r[0]["advisories"][0].update(lower_inclusive=None)),
        ("inverted_range", lambda r: r[0]["advisories"][0].update(lower="3")), ("label_twice", lambda r: r[0]["expected"].append("CVE-2024-1000")),
        ("labels_disagree", lambda r: r[0].update(expected=[])), ("labels_disagree", lambda r: r[0]["components"][0].update(version="1.10")), ("partition_missing", lambda r: r.pop()),
    ],
)
def test_every_rule_fails_the_read(spark, tmp_path, rule, change):
    rows = json.loads(json.dumps(fixture_rows()))
    change(rows)
    read, found = loaded(spark, tmp_path, rows, "bad")
    assert rule in {r.rule for r in found.collect()}
    with pytest.raises(Exception, match="violated"):
        audit.gated(read, found).collect()


VERSIONS = ["0", "0.0", "1", "1.0", "1.0.0", "1.2", "1.10", "1.9.9", "10", "2.0.1", "99999999999999999999.1", "99999999999999999999.02"]


def test_both_readings_of_a_criterion_agree(spark):
    """The padded texts order versions as the keys do, and both readers take names apart alike."""
    v = spark.createDataFrame([(x,) for x in VERSIONS[:-1]], "a string")
    pairs = v.join(v.withColumnRenamed("a", "b"), F.lit(True))
    a, b = F.col("a"), F.col("b")
    odd = pairs.where((reference.padded(a) < reference.padded(b)) != (vs.version_key(a) < vs.version_key(b)))
    assert odd.count() == 0 and pairs.where((reference.padded(a) == reference.padded(b)) != (vs.compare(a, b) == 0)).count() == 0
    names = [r"cpe:2.3:a:V\:x:lib\+y:*:*:*:*:*:*:*:*", "cpe:2.3:a:v:p:1.2:*:*:*:*:*:*:*"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(reference.named(F.col("n")).alias("r"), va.cpe_fields(F.col("n")).alias("f")).collect()
    assert [(r.r.vendor, r.r.product, r.r.version) for r in got] == [(r.f[1].lower(), r.f[2].lower(), None if r.f[3] == "*" else r.f[3]) for r in got]


def record(spark, affected, **head):
    row = {"cve": "CVE-1", "kind": "CVE_RECORD", "state": "PUBLISHED", "told": "CVE-1", "affected": affected} | head
    return spark.createDataFrame([row], f"cve string, kind string, state string, told string, affected array<{co.AFFECTED}>")


def product(**other):
    entry = {"version": "1.0", "lessThan": "2.0", "lessThanOrEqual": None, "versionType": "semver", "status": "affected", "changes": False}
    return {"vendor": "V", "product": "P", "cpes": None, "defaultStatus": "unaffected", "constraints": False, "versions": [entry | other.pop("entry", {})]} | other


def test_corroboration_of_awkward_records(spark):
    terms = spark.createDataFrame([("CVE-1", "v", "p", None, "1.0", "2.0", True, False)], "cve string, vendor string, product string, exact string, lower string, upper string, lower_inclusive boolean, upper_inclusive boolean")
    verdict = lambda rows, **head: co.corroborate(record(spark, rows, **head), terms).first()
    assert verdict([product()])[1:] == (None, 6)
    assert verdict(None).reason == "cna_missing_affected" and verdict([product()], told=None).reason == "cna_identity_or_publication_state"
    # The first faulty product decides, in order.
    assert verdict([product(product="q"), product(constraints=True)]).reason == "cna_product_identity_not_confirmed"
    assert verdict([product(), product()]).reason == "cna_duplicate_product_scopes"
    assert verdict([product(), product(constraints=True)]).reason == "cna_additional_platform_or_component_constraints"
    assert verdict([product(cpes=["cpe:2.3:a:v:p:*:*:*:*:*:*:*:*", "cpe:2.3:a:v:p:*:*:*:*:*:*:*:*"], vendor=None)]).reason is None
    assert verdict([product(cpes=["no name"])]).reason == "invalid_cpe_character"
    assert verdict([product(cpes=["cpe:2.3:a:v:p:1:*:*:*:*:*:*:*"])]).reason == "cna_cpe_constraints"
    assert verdict([product(versions=[product()["versions"][0]] * 33)]).reason == "cna_missing_or_excessive_versions"
    assert verdict([product(entry={"lessThan": None})]).reason == "nvd_cna_numeric_predicate_disagreement"
    assert verdict([product(entry={"version": "0"})]).reason == "nvd_cna_numeric_predicate_disagreement"
    assert verdict([product(entry={"lessThan": "2.00"})]).reason == "unsupported_numeric_version"


def test_the_first_fault_in_the_order_of_the_record(spark):
    terms = spark.createDataFrame([("CVE-1", "v", "p", None, "1.0", "2.0", True, False)], "cve string, vendor string, product string, exact string, lower string, upper string, lower_inclusive boolean, upper_inclusive boolean")
    reason = lambda *rows: co.corroborate(record(spark, list(rows)), terms).first().reason
    assert reason(product(), product(), product(constraints=True)) == "cna_duplicate_product_scopes"
    assert reason(product(), product(constraints=True), product()) == "cna_additional_platform_or_component_constraints"


def test_denial_window(spark):
    """Within 24 characters before the phrase, not beyond; offsets count characters, the phrase may repeat."""
    terms = spark.createDataFrame([(c, None, None, "2.1", True, False) for c in "abcd"], "cve string, exact string, lower string, upper string, lower_inclusive boolean, upper_inclusive boolean")
    texts = [("a", 0, "not " + "x" * 20 + " before 2.1"), ("b", 0, "fixed" + " " * 24 + "before 2.1"), ("c", 0, "é😀 not before 2.1, " + "y" * 30 + " Prior to version 2.1"), ("d", 0, "before 2.10, before 2.1.1"), ("d", 1, "below v2.1, it is")]
    got = co.prose_bounds(terms, spark.createDataFrame(texts, "cve string, place int, text string")).collect()
    assert {r.cve: r.phrase for r in got} == {"a": "before 2.1", "b": "before 2.1", "c": "Prior to version 2.1", "d": "below v2.1"}


def tail(k: int, n: int, p: float) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


@pytest.mark.parametrize(("k", "n"), [(1, 1), (3, 10), (17, 40), (39, 40), (250, 900)])
def test_incomplete_beta_is_the_binomial_tail(k, n):
    for p in (0.001, 0.2, 0.5, 0.77, 0.999):
        assert contracts.incomplete_beta(k, n - k + 1, p) == pytest.approx(tail(k, n, p), abs=1e-12)
    low, high = contracts.clopper_pearson(k, n)
    assert tail(k, n, low) == pytest.approx(0.025, abs=1e-9) and (k == n or 1 - tail(k + 1, n, high) == pytest.approx(0.025, abs=1e-9))


def test_limits_of_large_counts():
    low, high = contracts.clopper_pearson(3_000_000, 10_000_000)
    assert 0.2997 < low < 0.3 < high < 0.3003 and contracts.clopper_pearson(0, 0) == (0.0, 1.0)


def test_nested_weights_keep_their_totals(spark):
    """Every draw of a system draws as many sub-profiles as it has, and each of these as many cells."""
    cells = spark.range(60).selectExpr("id % 4 AS system", "id % 12 AS sub", "id AS cell")
    got = rs.nested_weights(cells, "system", "sub", "cell", 20, "t").toPandas()
    # All systems have 3 sub-profiles of 5 cells, so every replicate draws 60 cells.
    assert set(got.groupby("replicate").weight.sum()) == {60}
    of_systems = got.groupby(["replicate", "system"]).weight.sum()
    assert set(of_systems % 15) == {0} and of_systems.max() > 15


def test_reconstruction_takes_nothing_from_stored_verdicts(spark):
    specs = spark.createDataFrame([("s", "main/p", "b", "executor", "p", "c", ["1", "2"], ["m"], "l")], "spec string, key string, body string, role string, profile string, condition string, allowed array<string>, models array<string>, provider string")
    attempts = spark.createDataFrame([("s/1", "s", "b", "l")], "attempt string, spec string, body string, provider string")
    responses = spark.createDataFrame([("s/1", '{"applicable": ["1"]}', "stop", 200, "m", "l", "x")], "attempt string, raw string, finish string, http int, model string, returned string, sha256 string")
    truth = spark.createDataFrame([("p", ["1", "2"], ["1"])], "profile string, candidates array<string>, expected array<string>")
    for told, value in (("valid", ["2"]), ("invalid_output", None)):
        results = spark.createDataFrame([("s", "main/p", "s/1", "x", told, value)], "spec string, key string, attempt string, response_sha256 string, status string, value array<string>")
        read = reconstruction.reread(specs, attempts, responses, results)
        scored = reconstruction.scored(read, truth)
        assert scored.select("status", "value", "tp", "fp", "fn").first()[:] == ("valid", ["1"], 1, 0, 0)
        stored = spark.createDataFrame([("main/p", 1, 0, 0)], "key string, tp long, fp long, fn long")
        assert [r.rule for r in reconstruction.reconstruction_violations(specs, attempts, read, scored, stored).collect()] == ["interpretation_differs"]


@pytest.mark.parametrize(
    ("raw", "good"),
    [
        ('{"applicable": ["a"], "decisions": [{"id": "a", "applicable": true}, {"id": "b", "applicable": false}]}', True),
        ('{"decisions": [{"id": "b", "applicable": false}, {"applicable": true, "id": "a"}], "applicable": ["a"]}', True),
        ('{"applicable": ["a"]}', False), ('{"applicable": [], "decisions": [{"id": "a", "applicable": true}, {"id": "b", "applicable": false}]}', False),
        ('{"applicable": ["a"], "decisions": [{"id": "a", "applicable": 1}, {"id": "b", "applicable": 0}]}', False), ('{"applicable": ["a"], "decisions": {"a": true}}', False),
        ('{"applicable": ["a"], "decisions": [{"id": "a", "applicable": true}, {"id": "a", "applicable": true}, {"id": "b", "applicable": false}]}', False),
        ('{"applicable": ["a"], "decisions": [{"id": "a", "applicable": true}, {"id": "b", "applicable": false}, {"id": "c", "applicable": false}]}', False),
    ],
)
def test_scaffold_must_agree_with_the_answer(raw, good):
    assert contracts.answer(raw, "stop", ["a", "b"], "applicable", "decisions") == (["a"] if good else None)
