"""Generators with sequential state, and what a model sees and answers: plans for recorded inference."""

from __future__ import annotations

import random
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROFILE = "pool string, profile bigint, stratum string, positive boolean, candidates array<string>, required array<string>"
STRATA = ("easy", "medium", "hard")


def profiles(advisories: DataFrame, per_pool: int, seed: int, least: int = 15, most: int = 25, tries: int = 200, per_shard: int = 500) -> DataFrame:
    """Profiles per pool by rejection sampling: strata in turn, every second one positive, 15 to 25
    candidates of which at least 30 % are of other products than the anchor, no candidate set twice.

    advisories: pool, cve, product. A pool's profiles are made in shards of per_shard, each a task with a seeded stream of its own
    that sees the pool's advisories (small by construction: they were admitted one by one). Should two shards draw one set,
    the later profile goes."""
    shards = -(-per_pool // per_shard)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pool, shard = pdf["pool"].iloc[0], int(pdf["shard"].iloc[0])
        rng, seen, out = random.Random(f"{seed}/{pool}/{shard}"), set(), []
        rows = sorted(zip(pdf["cve"], pdf["product"], strict=True))
        by: dict[str, list[str]] = {}
        for c, p in rows:
            by.setdefault(p, []).append(c)
        for i in range(shard * per_shard, min(per_pool, (shard + 1) * per_shard)):
            for _ in range(tries):
                cve, product = rng.choice(rows)
                own = [c for c in by[product] if c != cve]
                other = [c for c, p in rows if p != product]
                n = rng.randint(least, most) - 1
                far = max(-(-3 * (n + 1) // 10), n - len(own))
                if far > len(other):
                    continue
                chosen = tuple(sorted([cve, *rng.sample(other, far), *rng.sample(own, n - far)]))
                if chosen not in seen:
                    seen.add(chosen)
                    out.append((pool, i, STRATA[i % 3], i % 2 == 0, list(chosen), [cve] if i % 2 == 0 else []))
                    break
        return pd.DataFrame(out, columns=["pool", "profile", "stratum", "positive", "candidates", "required"])

    dealt = advisories.select("pool", "cve", "product", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    made = dealt.groupBy("pool", "shard").applyInPandas(make, PROFILE)
    first = F.min(F.struct("profile", "stratum", "positive", "required"))
    return made.groupBy("pool", "candidates").agg(first.alias("x")).select("pool", "x.profile", "x.stratum", "x.positive", "candidates", "x.required")


def provider_answer(prompt: Column, candidates: Column, truth: Column) -> Column:
    """A stand-in for a model, by rule: cautious prompts answer exactly, eager ones name every candidate, others the first."""
    return F.when(prompt.contains("exact"), truth).when(prompt.contains("all"), candidates).otherwise(F.slice(candidates, 1, 1))


def executor_input(profile: Column, text: Column, candidates: Column, prose: Column) -> Column:
    """What a model may see: inventory and advisories with prose in place of clauses; no labels."""
    shown = F.transform(candidates, lambda c: F.struct(c["id"].alias("id"), F.coalesce(F.element_at(prose, c["id"]), c["affected"]).alias("affected")))
    return F.to_json(F.struct(profile.alias("profile"), text.alias("inventory"), shown.alias("advisories")))


def feedback(tier: Column, micro_f1: Column, counts: Column, relations: Column, examples: Column) -> Column:
    """Feedback by tier as JSON: scores; and relations; and examples. Lower tiers hold nothing of the higher."""
    base = [micro_f1.alias("micro_f1"), counts.alias("counts")]
    return (
        F.when(tier == 1, F.to_json(F.struct(*base)))
        .when(tier == 2, F.to_json(F.struct(*base, relations.alias("relations"))))
        .otherwise(F.to_json(F.struct(*base, relations.alias("relations"), examples.alias("examples"))))
    )
