"""Faults that only larger or odd tables showed, on small ones."""

from __future__ import annotations

import os

import duckdb
from pyspark.sql import functions as F

from quillwork.functions import text as tx
from quillwork.functions import validation as va
from quillwork.operators import audit, graph, joins, lineage
from quillwork.plans import audits, registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def ran(df) -> str:
    """The plan that adaptive execution came to."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def linked(tmp_path, sf: str, **replaced) -> str:
    """A copy of the tables of sf in which some are replaced."""
    for name in os.listdir(sf):
        if name.endswith(".parquet") and name[:-8] not in replaced:
            os.symlink(f"{sf}/{name}", tmp_path / name)
    for name, df in replaced.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_resampling_sends_no_side_to_the_driver(spark, sf):
    for name in ("two_stage_bootstrap_ci", "three_stage_bootstrap_ci", "pigeonhole_ci", "joint_bootstrap_ci"):
        assert "BroadcastHashJoin" not in ran(QUERIES[name](spark, sf)), name


def by_sql(tables: str, name: str) -> list[tuple]:
    with duckdb.connect() as db:
        for file in sorted(os.listdir(tables)):
            path = f"{tables}/{file}"
            db.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{path}'")
        return sorted(db.sql(SQL[name]).fetchall())


def test_the_audit_meets_only_asked_pairs(spark, sf, monkeypatch):
    components = spark.createDataFrame([(1, "a", "V", "p", "1.5"), (1, "a", "v", "p", "9.0"), (2, "a", "v", "p", "1.5"), (2, "b", "v", "p", "1.5")], "profile int, part string, vendor string, product string, version string")
    terms = spark.createDataFrame([("x", "v", "P", None, "1.0", "2.0", True, False), ("y", "v", "p", "7.0", None, None, False, False)], "cve string, vendor string, product string, exact string, lower string, upper string, lower_inclusive boolean, upper_inclusive boolean")
    every = {tuple(r) for r in joins.applicability(components, terms).collect()}
    asked = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "x")], "profile int, cve string")
    assert {tuple(r) for r in joins.applicability_of(asked, components, terms).collect()} == {r for r in every if r[:2] in {(1, "x"), (2, "y")}}

    def all_records(*_):
        raise AssertionError("components meet all records of their name")

    monkeypatch.setattr(joins, "applicability", all_records)
    QUERIES["profile_audit"](spark, sf)


def test_the_audit_sends_each_line_once(spark, sf, monkeypatch):
    plans, write = [], audit.written

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(audit, "written", kept)
    for name in ("profile_audit", "profile_audit_counts"):
        plans.clear()
        QUERIES[name](spark, sf)
        # The lines by part, the parts, and the lines by profile.
        assert len(plans) == 1 and plans[0].count("FileScan parquet [l_orderkey") == 1 and plans[0].count("Exchange") <= 4, plans


def test_flat_profiles_are_audited_as_nested_ones(spark, sf):
    whole, groups = audits._benchmark(spark, sf)
    flat = lambda name: whole.selectExpr("profile", f"inline({name})")
    told = flat("candidates").withColumn("body", F.col("cve")).withColumn("sha256", F.sha2(F.when(F.col("unchanged"), F.col("body")).otherwise("x"), 256)).withColumn("published", F.concat("year", F.lit("-03-01")))
    source = {name: told.select("cve", *columns).dropDuplicates(["cve"]) for name, columns in {"advisories": ["body", "matches"], "assigned": ["assigned"]}.items()}
    found = audit.profile_violations(flat("profiles"), flat("components"), told.select("profile", "cve", "sha256", "terms", "published"), **source, groups=groups, limits=audits._LIMITS)
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in QUERIES["profile_audit"](spark, sf).collect())


def test_a_profile_without_parts_breaks_the_rules(spark):
    lists = "profile long, partition string, stratum string, text string, expected array<string>, distractors array<string>, pair array<string>"
    profiles = spark.createDataFrame([(1, "validation", "hard", "h", [], [], [])], lists)
    components = spark.createDataFrame([], "profile long, position int, vendor string, product string, version string, style string")
    candidates = spark.createDataFrame([], f"profile long, cve string, sha256 string, terms array<{audit.TERM}>, published string")
    advisories = spark.createDataFrame([], f"cve string, body string, matches array<{va.MATCH}>")
    groups = spark.createDataFrame([], "vendor string, product string, product_group string")
    found = audit.profile_violations(profiles, components, candidates, advisories, spark.createDataFrame([], "cve string, assigned string"), groups)
    assert sorted(r.rule for r in found.collect()) == ["candidate_twice", "difficulty_contract", "hard_without_branches", "stored_labels_disagree", "text_differs_from_components"]


def test_audit_counts_read_the_audit_once(spark, sf):
    assert "ubquery" not in ran(QUERIES["profile_audit_counts"](spark, sf))


def test_many_lines_are_no_fault_of_an_advisory(spark, sf, tmp_path):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") % 150).withColumn("l_quantity", F.least("l_quantity", F.lit(9.0)))
    last = lines.limit(1).withColumn("l_orderkey", F.lit(10).cast("long")).withColumn("l_quantity", F.lit(50.0))
    tables = linked(tmp_path, sf, lineitem=lines.unionByName(lines.where("l_orderkey = 10")).unionByName(lines.where("l_orderkey = 10")).unionByName(last))
    assert sorted(tuple(r) for r in QUERIES["advisory_validation"](spark, tables).collect()) == by_sql(tables, "advisory_validation")


def test_streams_read_a_table_of_many_files(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").repartition(3)
    tables = linked(tmp_path, sf, events=events)
    for name in ("stream_soak", "stream_progress", "stream_journal_once"):
        for place in (sf, tables):
            got = sorted(tuple(r) for r in QUERIES[name](spark, place).collect())
            assert got and got == by_sql(place, name), (name, place)


def test_rounds_without_a_time_or_a_user(spark, sf, tmp_path):
    rows = [(i, 1, 100.0 if i % 3 else None) for i in range(20)] + [(100 + i, 2, None) for i in range(45)] + [(200 + i, None, 500.0) for i in range(5)] + [(300 + i, 3, 50.0) for i in range(3)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double").selectExpr("event_id", "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, event_id) AS ts", "user_id", "'view' AS event_type", "value", "'{}' AS props")
    tables = linked(tmp_path, sf, events=events)
    got = {tuple(r) for r in QUERIES["stream_soak"](spark, tables).collect()}
    assert got == {(1, "completed", 14, 900.0), (2, "ceiling", 40, None)} == set(by_sql(tables, "stream_soak"))


def test_reconstruction_reads_the_lines_once(spark, sf):
    assert not any("lineitem" in file for file in QUERIES["reconstruction_violations"](spark, sf).inputFiles())


def test_fixture_builds_its_profiles_once(spark, sf):
    assert not any("lineitem" in file for file in QUERIES["fixture_load"](spark, sf).inputFiles())


def test_fixture_sends_each_line_once(spark, sf, monkeypatch):
    plans, write = [], audits.written

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(audits, "written", kept)
    text = QUERIES["fixture_load"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    # The lines by part, the parts, and the lines with their orders; a profile is then checked where it lies.
    assert plans[0].count("FileScan parquet [l_orderkey") == 1 and plans[0].count("Exchange") <= 3 and "Join" not in text


def test_records_meet_their_advisories_in_one_join(spark, sf):
    text = ran(QUERIES["corroboration_rules"](spark, sf)).split("Initial Plan")[0]
    assert text.count("SortMergeJoin") + text.count("BroadcastHashJoin") + text.count("ShuffledHashJoin") == 1
    assert "Generate explode" not in text and "Generate posexplode" not in text


def test_entries_are_parsed_once(spark):
    raws = [
        '{"containers":{"cna":{"affected":[{"product":"p","zeta":"","a":["x","y"],"b":[],"c":{"d":1},"e":"[1"},{},7]},"adp":[{},{"affected":[{"vendor":"","versions":[{"version":"1","changes":[{}]}]}]}]}}',
        '{"containers":{}}', "no json", None,
    ]
    got = spark.createDataFrame([(r,) for r in raws], "raw string").coalesce(1).select(tx.rendered_entries(F.col("raw")).alias("text"))
    first = 'n/a / p: a: x, y; c: {"d":1}; e: [1\nn/a / n/a: no version data\nn/a / n/a: no version data\n(ADP enrichment) n/a / n/a: None: 1; changes: None at None'
    assert [r.text for r in got.collect()] == [first, "", "", ""]
    # A record, then for each kind of entry its known fields, all its fields, and a list among these.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 7


def test_parts_of_a_graph_grow_with_its_edges(spark, sf, monkeypatch):
    edges, cut = [], graph.checkpointed

    def counted(df):
        if df.columns == ["x", "y"]:
            edges.append(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        return cut(df)

    monkeypatch.setattr(graph, "checkpointed", counted)
    monkeypatch.setattr(lineage, "ROWS_A_TASK", 500, raising=False)
    for name in ("pool_assignment", "product_components"):
        edges.clear()
        text = ran(QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and len(edges) == 1
        assert len(edges[0]) >= 20 and max(edges[0]) <= 1500, edges
