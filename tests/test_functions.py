"""Truth tables and grids of single functions."""

import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from quillwork.functions import contracts
from quillwork.functions import score as sc
from quillwork.functions import text as tx
from quillwork.functions import validation as va
from quillwork.functions import version as vs
from quillwork.operators import aggregates as ag
from quillwork.operators import generate, graph, joins
from quillwork.operators import ordered as od

GRID = ["0", "0.0", "1", "1.0", "1.2", "1.2.0", "1.9", "1.10", "2", "10", "999999999999999999999.1"]


def number(v: str) -> tuple:
    parts = [int(x) for x in v.split(".")]
    while parts and parts[-1] == 0:
        parts.pop()
    return tuple(parts)


def test_version_grid(spark):
    pairs = list(itertools.product(GRID, GRID))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", vs.compare(F.col("a"), F.col("b")).alias("c"))
    for a, b, c in df.collect():
        assert c == (number(a) > number(b)) - (number(a) < number(b)), (a, b)


def test_unsupported_versions(spark):
    bad = ["1.0rc1", "*", "-", "1..0", "", "v1.0", "-1", "１.０", "01.10", "1." * 60 + "1"]
    df = spark.createDataFrame([(x,) for x in bad], "v string")
    assert df.where(vs.version_key(F.col("v")).isNotNull()).count() == 0
    lenient = spark.createDataFrame([("01.10", "1.10"), ("1.00", "1"), ("007", "7")], "a string, b string")
    assert all(r.same for r in lenient.select((vs.lenient_key(F.col("a")) == vs.lenient_key(F.col("b"))).alias("same")).collect())


@pytest.mark.parametrize("low,high", list(itertools.product([True, False], repeat=2)))
def test_ranges(spark, low, high):
    df = spark.createDataFrame([(v,) for v in GRID], "v string")
    k = lambda x: vs.version_key(F.lit(x))
    hit = vs.in_range(vs.version_key(F.col("v")), F.lit(None), k("1.2"), k("1.10"), F.lit(low), F.lit(high))
    for v, got in df.select("v", hit.alias("hit")).collect():
        n = number(v)
        assert got == ((n > (1, 2) or (low and n == (1, 2))) and (n < (1, 10) or (high and n == (1, 10))))


def test_applicability_truth_table(spark):
    rows = [("vendor", "product", "1.1", 0), ("vendor", "product", "1.2", 1), ("vendor", "product", "1.2.0", 1), ("vendor", "product", "1.9", 1), ("vendor", "product", "1.10", 0),
            ("vendor", "product", "2", 0), ("VENDOR", "PRODUCT", "1.3", 1), ("other", "product", "1.3", None), ("vendor", "product_extra", "1.3", None)]
    have = spark.createDataFrame([(i, "a", v, p, x) for i, (v, p, x, _) in enumerate(rows)] + [(99, "o", "vendor", "product", "1.3")], "profile int, part string, vendor string, product string, version string")
    terms = spark.createDataFrame([("C", "vendor", "product", None, "1.2", "1.10", True, False)], "cve string, vendor string, product string, exact string, lower string, upper string, lower_inclusive boolean, upper_inclusive boolean")
    got = {r.profile: r.applies for r in joins.applicability(have, terms).collect()}
    assert got == {i: bool(x) for i, (_, _, _, x) in enumerate(rows) if x is not None}


def test_position(spark):
    """Every version of the grid against every pair of bounds, by comparing tuples."""
    ends = [None, "1.2", "1.10"]
    cases = [(v, a, b, i, j) for v in GRID for a in ends for b in ends for i in (True, False) for j in (True, False) if not (a and b) or number(a) <= number(b)]
    df = spark.createDataFrame(cases, "v string, a string, b string, i boolean, j boolean")
    got = df.select("*", vs.position(*[vs.version_key(F.col(c)) for c in "vab"], F.col("i"), F.col("j")).alias("got")).collect()

    def place(v, a, b, i, j):
        for bound, inclusive, side in ((a, i, "below"), (b, j, "above")):
            if bound is not None and number(v) == number(bound):
                return "on_inclusive" if inclusive else "on_exclusive"
            if bound is not None and (number(v) < number(bound)) == (side == "below"):
                return side
        return "above" if a is not None else "below" if b is not None else None

    assert all(r.got == place(r.v, r.a, r.b, r.i, r.j) for r in got)


def test_inventory_and_clauses(spark):
    names, versions = ["blue heron", "Kiln", "north/gate", "a-b.c"], ["4.10", "2", "0.0.7-beta"]
    items = [(n, v, style) for n in names for v in versions for style in ("{}@{}", "- {}@{}", "- {} {}", "{}\t{}")]
    text = "\n\n".join(style.format(n, v) for n, v, style in items) + "\nalone\n"
    got = [tuple(x) for x in spark.createDataFrame([(text,)], "t string").select(tx.inventory(F.col("t"))).first()[0]]
    assert got == [(n, v) for n, v, _ in items] + [("alone", None)]
    clauses = [(">= 3.1 and < 3.40", 2), ("= 5", 1), ("versions before 8.0 of it", 1), ("some of them", None), (">= 1 or so", None)]
    df = spark.createDataFrame(clauses, "c string, n int").select("n", tx.clause_conditions(F.col("c")).alias("x"))
    for n, x in df.collect():
        assert (None if x is None else len(x)) == n
    v = spark.createDataFrame([("3.9", ">= 3.1 and < 3.40", True), ("3.40.0", ">= 3.1 and < 3.40", False), ("3.40", "> 3.1 and <= 3.40", True), ("5.0", "= 5", True), ("3-x", "< 9", None)], "v string, c string, want boolean")
    assert all(r.want == r.got for r in v.select("want", joins.clause_verdict(F.col("v"), tx.clause_conditions(F.col("c"))).alias("got")).collect())


def test_key_parsing(spark):
    """Keys made of fields by the rule of each arm, and read back."""
    cases = []
    for executor in ("m1", "host/m2:7b", "a/b/c"):
        for arm in ("main", "gepa", "reference"):
            for stage in ("s", "s/t", "T3/Rx", ""):
                cases.append(("/".join(x for x in (arm, executor, "T2", "R11", stage, "item") if x), (arm, executor, "2", "11", stage, "")))
        cases += [
            (f"sealed/{executor}/held/x/item", ("sealed", executor, "", "", "", "held")), (f"selection/{executor}/x/item", ("selection", executor, "", "", "", "validation")),
            (f"ceiling/{executor}/later/item", ("ceiling", executor, "", "", "", "later")), (f"real_record/{executor}/0f/item", ("real_record", executor, "", "", "", "real_record")),
            *[(f"{arm}/{executor}/plain/item", (arm, executor, "", "", "plain", "")) for arm in ("calibration", "scaffolding")], (f"odd/{executor}", ("odd", "", "", "", "", "")),
        ]
    cases += [("odd", ("odd", "", "", "", "", "")), ("main/x/y/z", ("main", "", "", "", "", ""))]
    got = spark.createDataFrame([(k,) for k, _ in cases], "k string").select("k", tx.split_key(F.col("k")).alias("x")).collect()
    assert {r.k: tuple(r.x) for r in got} == dict(cases)


def test_three_valued_any(spark):
    df = spark.createDataFrame([(1, True), (1, None), (2, False), (2, None), (3, False)], "g int, v boolean")
    assert {r.g: r.v for r in df.groupBy("g").agg(vs.any_verdict(F.col("v")).alias("v")).collect()} == {1: True, 2: None, 3: False}


def test_scores_of_failed_and_empty_answers(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["a"], None), (2, ["a", "b"], ["a"], [])], "i int, c array<string>, t array<string>, p array<string>")
    got = {r.i: tuple(r.s) for r in df.select("i", sc.counts(F.col("c"), F.col("t"), F.col("p")).alias("s")).collect()}
    assert got == {1: (0, 1, 1), 2: (0, 0, 1)}
    pooled = spark.createDataFrame([(9, 0, 0, True), (0, 0, 1, True)], "tp int, fp int, fn int, valid boolean").agg(*sc.metrics()).first()
    assert pooled.micro_f1 == round(18 / 19, 6) and pooled.coverage == 1.0


KNOWN = ["north", "south", "west"]


def answers():
    """(raw, ids or None): every object of up to two pairs, written out by hand, with the verdict that its parts call for."""
    values = ['"north"', '"south"', '"elsewhere"', "7", "null", "NaN", '["west"]', "{}"]
    lists = [[], *[[a] for a in values], *[[a, b] for a in values[:4] for b in values[:4]]]
    for items in lists:
        good = all(i.strip('"') in KNOWN and i.startswith('"') for i in items) and len(set(items)) == len(items)
        listed = "[" + ", ".join(items) + "]"
        yield f'{{"picked": {listed}}}', sorted(i.strip('"') for i in items) if good else None
        yield f' {{"picked":{listed}}} \n', sorted(i.strip('"') for i in items) if good else None
        for other in (f'{{"picked": {listed}, "note": 1}}', f'{{"picked": {listed}, "picked": {listed}}}', f'{{"chosen": {listed}}}', listed, f'so: {{"picked": {listed}}}', f'{{"picked": {listed}', f"{{'picked': {listed}}}"):
            yield other, None
    for scalar in ("0", "false", '"north"', "", " ", "{", "nul"):
        yield scalar, None
        yield f'{{"picked": {scalar}}}', None


def test_strict_answers():
    for raw, ids in answers():
        assert contracts.answer(raw, "stop", KNOWN, "picked") == ids, raw
        assert all(contracts.answer(raw, finish, KNOWN, "picked") is None for finish in (None, "", "STOP", "cut", "error"))
    assert contracts.answer(None, "stop", KNOWN, "picked") is None


def test_canonical():
    assert contracts.canonical({"b": 1e-05, "a": ["é", None]}) == '{"a":["é",null],"b":1e-05}'


def cpe_by_hand(name):
    """The fields of a name, or why it is none, character by character."""
    parts, escape = [""], False
    if name is None or len(name) > 2048:
        return "invalid_cpe"
    for c in name:
        if escape:
            if not c.isascii() or c.isalnum() or c.isspace() or c in "*?":
                return "unsupported_cpe_escape"
            parts[-1] += c
            escape = False
        elif c == "\\":
            escape = True
        elif c == ":":
            parts.append("")
        elif c.isascii() and c.isalnum() or c in "_.-*?":
            parts[-1] += c
        else:
            return "invalid_cpe_character"
    return parts[2:] if not escape and len(parts) == 13 and parts[:2] == ["cpe", "2.3"] else "invalid_cpe"


def test_cpe_names(spark):
    import random

    rng, pieces = random.Random(5), ["a", "o", "Kiln", "b_c", "*", "?", "-", "", "x\\:y", "p\\+q", "\\\\", "\\", "\\*", "\\ ", "s p", "é", "\\é", "\n", "1.0"]
    names = [None, "", "cpe", "cpe:2.3:" + "a" * 2100] + ["cpe:2.3:" + ":".join(rng.choice(pieces) if rng.random() < 0.35 else rng.choice("abc*") for _ in range(rng.choice((11, 11, 11, 10, 12)))) for _ in range(400)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", va.cpe_reason(F.col("n")).alias("reason"), va.cpe_fields(F.col("n")).alias("fields")).collect()
    for r in got:
        want = cpe_by_hand(r.n)
        assert (r.reason, r.fields) == ((want, None) if isinstance(want, str) else (None, want)), r.n
    assert len({r.reason for r in got}) == 4


def test_status_and_corroboration(spark):
    """Truth tables of a producer's entries, and agreement with a range by trying many versions."""
    entries = [("1.2", None, None), ("1.2", "1.10", None), ("1.2", None, "1.10"), ("1.2", "*", None), ("2", "3", None)]
    held = lambda v, e: number(v) == number(e[0]) if not (e[1] or e[2]) else number(v) >= number(e[0]) and (e[1] == "*" or number(v) < number(e[1] or e[2]) or (e[2] is not None and number(v) == number(e[2])))
    rows = [(v, [(*e, "affected") for e in pair]) for v in GRID for pair in itertools.combinations(entries, 2)] + [(v, []) for v in GRID]
    kind = "array<struct<version:string,lessThan:string,lessThanOrEqual:string,status:string>>"
    df = spark.createDataFrame(rows, f"v string, e {kind}").select("v", "e", va.status_for(F.col("e"), F.lit("unaffected"), F.col("v")).alias("s"))
    for r in df.collect():
        n = sum(held(r.v, e) for e in r.e)
        assert tuple(r.s) == ((None, "cna_overlapping_version_entries") if n > 1 else ("affected" if n else "unaffected", None))
    many = [f"{a}.{b}" for a in range(4) for b in range(13)] + ["1.2.0.1", "1.9.9", "1.10.0.1"]
    terms = [(None, low, high, i, j) for low in (None, "1.2") for high in (None, "1.10") for i in (True, False) for j in (True, False)] + [("1.2", None, None, False, False)]
    inside = lambda v, t: number(v) == number(t[0]) if t[0] else (t[1] is None or number(v) > number(t[1]) or (t[3] and number(v) == number(t[1]))) and (t[2] is None or number(v) < number(t[2]) or (t[4] and number(v) == number(t[2])))
    cases = [(t, [(*e, "affected")]) for t in terms for e in entries]
    df = spark.createDataFrame(cases, f"t struct<exact:string,lower:string,upper:string,lower_inclusive:boolean,upper_inclusive:boolean>, e {kind}")
    for r in df.select("t", "e", va.corroborated(F.col("t"), F.col("e"), F.lit("unaffected")).alias("same")).collect():
        assert r.same == all(inside(v, tuple(r.t)) == held(v, tuple(r.e[0])) for v in many), r


@pytest.mark.parametrize("k,n", [(0, 10), (10, 10), (3, 10), (50, 80), (0, 0)])
def test_exact_limits(k, n):
    low, high = contracts.clopper_pearson(k, n)
    assert 0 <= low <= high <= 1
    if 0 < k < n:
        tail = lambda p, r: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in r)
        assert abs(tail(low, range(k, n + 1)) - 0.025) < 1e-9 and abs(tail(high, range(k + 1)) - 0.025) < 1e-9


def test_energy_with_gap_and_missing_sample(spark):
    frames = spark.createDataFrame([("g", i, float(t), p) for i, (t, p) in enumerate([(0, 10.0), (1, 20.0), (2, None), (9, 30.0), (10, 50.0)])], "gpu string, sequence long, t double, p double")
    r = od.energy(frames, "gpu", "t", "p", "sequence", 2.5).first()
    assert (r.joules, r.covered_s, r.pairs) == (55.0, 2.0, 2)


def test_chain(spark):
    df = spark.createDataFrame([("g", 0, "a", None), ("g", 1, "b", "a"), ("g", 3, "c", "b"), ("g", 4, "d", "x")], "g string, s long, d string, p string")
    assert sorted(r.s for r in od.chained(df, ["g"], "s", "d", "p").collect()) == [3, 4]


def test_pareto_against_all_pairs(spark):
    rows = [(i, (i * 7) % 11, (i * 5) % 13) for i in range(60)]
    got = {r.i for r in joins.pareto(spark.createDataFrame(rows, "i int, f int, d int"), "f", "d").collect()}
    assert got == {i for i, f, d in rows if not any(f2 >= f and d2 <= d and (f2 > f or d2 < d) for _, f2, d2 in rows)}


def test_components_of_a_long_chain(spark):
    got = {r.node: r.root for r in graph.components(spark.range(1, 40).selectExpr("id as a", "id + 1 as b").unionAll(spark.createDataFrame([(100, 101)], "a long, b long")), "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_ledger(spark):
    df = spark.createDataFrame([("r", "p", None, "1"), ("r", "p", "0.01", "1")], "request string, provider string, cost string, reserved string")
    df = df.withColumns({c: F.col(c).cast("decimal(38,18)") for c in ("cost", "reserved")})
    r = ag.ledger(df).first()
    assert (r.attempts, float(r.cost), float(r.reserved)) == (1, 0.01, 0.0)


def test_distribution_keeps_nulls(spark):
    r = ag.distribution(spark.createDataFrame([(1, 3.0), (1, None), (1, 1.0)], "g int, x double"), ["g"], "x").first()
    assert (r.known, r.missing, r.total, r.known_total, r.mean_known) == (2, 1, None, 4.0, 2.0)


def test_generated_profiles_meet_their_constraints(spark):
    adv = spark.createDataFrame([("p", f"C{i}", f"prod{i % 12}") for i in range(96)], "pool string, cve string, product string")
    got = generate.profiles(adv, 12, 42).collect()
    product = {f"C{i}": i % 12 for i in range(96)}
    assert len(got) == 12 and sum(r.positive for r in got) == 6 and len({tuple(r.candidates) for r in got}) == 12
    for r in got:
        assert 15 <= len(r.candidates) <= 25 and len(set(r.candidates)) == len(r.candidates) and set(r.required) <= set(r.candidates)
        assert max(sum(product[c] != p for c in r.candidates) for p in range(12)) >= 0.3 * len(r.candidates)


def test_shards_of_a_pool_are_numbered_through(spark):
    adv = spark.createDataFrame([(p, f"{p}{i}", f"prod{i % 12}") for p in "ab" for i in range(96)], "pool string, cve string, product string")
    got = generate.profiles(adv, 25, 7, per_shard=4).collect()
    assert sorted((r.pool, r.profile) for r in got) == [(p, i) for p in "ab" for i in range(25)]
    assert len({tuple(r.candidates) for r in got}) == 50 and all(c.startswith(r.pool) for r in got for c in r.candidates)
    assert all(r.positive == (r.profile % 2 == 0) and r.stratum == generate.STRATA[r.profile % 3] for r in got)
    again = generate.profiles(adv.repartition(7), 25, 7, per_shard=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_strict_json():
    assert contracts.strict_json(json.dumps({"a": 1})) == {"a": 1}
    for bad in ('{"a":1,"a":2}', "[NaN]", "[Infinity]"):
        with pytest.raises(ValueError):
            contracts.strict_json(bad)
