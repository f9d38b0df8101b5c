"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

The mean repetition rate of a document is its group's target share over its present share.  A uniform number seeded by a
hash of the document is put through the inverse of the Poisson distribution of that mean; the document is repeated that
often (perhaps never), and all copies are shuffled globally by a hash.  The same seed gives the same mixture on any cluster.

Shares count rows.  Groups without a stated weight share what the stated ones leave in proportion to their rows; with
``others`` they keep the share they have, and the stated ones present divide the rest by their weights.

Defined cases: a null group is a group of its own (without a stated weight); documents with the same id are repeated
alike, those without an id by all their columns; any rate is drawn exactly, at a cost of its logarithm a document and of
the copies made; an empty table gives an empty mixture; columns named like the added ones (copy, copies, shuffle_key) are
replaced, no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import unused

#: Groups whose distributions are broadcast at most.
SMALL = 10_000


def uniform(text: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5 digest."""
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def rates(docs: DataFrame, weights: dict[str, float], group: str, others: bool = False) -> DataFrame:
    """(group, rate): one row for each group, its mean number of copies."""
    count = docs.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n"))
    named = F.lit(0.0)
    for k, v in weights.items():
        named = F.when(F.col("_g") == k, F.lit(float(v))).otherwise(named)
    count = count.withColumn("w", named)
    rest = max(0.0, 1.0 - sum(weights.values()))
    total = count.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("w") == 0, F.col("n"))).alias("other"))
    both = count.join(F.broadcast(total))  # total is one row
    rate = F.when(F.col("w") > 0, F.col("w") * F.col("all") / F.col("n")).otherwise(F.lit(rest) * F.col("all") / F.col("other"))
    if others:
        both = count.join(F.broadcast(total.join(count.agg(F.sum("w").alias("stated")))))
        ours = F.col("all") - F.coalesce("other", F.lit(0))
        rate = F.when(F.col("w") > 0, F.col("w") / F.col("stated") * ours / F.col("n")).otherwise(F.lit(1.0))
    return both.select("_g", rate.alias("_rate"))


def thresholds(rate: DataFrame) -> DataFrame:
    """(_g, _steps): the distribution function of each group at 0, 1, 2, ... as far as a double can tell it from 1.

    The terms are rows, so logarithms of factorials and probabilities are running sums: the work grows with the rate.
    """
    top = F.ceil(F.col("_rate") + 12 * F.sqrt("_rate") + 24).cast("int")
    term = rate.where("_rate > 0").select("_g", "_rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    w = Window.partitionBy("_g").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    term = term.withColumn("_lf", F.sum(F.log(F.greatest(F.lit(1), F.col("k")).cast("double"))).over(w))
    term = term.withColumn("f", F.sum(F.exp(F.col("k") * F.log("_rate") - F.col("_rate") - F.col("_lf"))).over(w))
    some = term.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "f"))), lambda s: s["f"]).alias("_steps"))
    return some.unionByName(rate.where(~F.coalesce(F.col("_rate") > 0, F.lit(False))).select("_g", F.array(F.lit(1.0)).alias("_steps")))


def below(steps: Column, u: Column) -> Column:
    """How many of the rising steps are less than u, by halving: as many looks as the number of steps has bits."""
    start = F.struct(F.lit(0).alias("lo"), F.size(steps).alias("hi"))
    bits = F.sequence(F.lit(1), F.ceil(F.log2(F.size(steps) + 1)).cast("int") + 1)

    def look(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        less = (s["lo"] < s["hi"]) & (F.element_at(steps, F.least(mid + 1, F.size(steps))) < u)
        return F.struct(F.when(less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(less | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(bits, start, look, lambda s: s["lo"])


def mix(docs: DataFrame, weights: dict[str, float], group: str, seed: str = "mix", key: str = "doc_id", shuffle: bool = True, others: bool = False) -> DataFrame:
    """The rows of ``docs``, each as often as its draw says, with ``copy`` (from 0), ``copies`` and ``shuffle_key``.

    The distribution is one array for each group.  Up to SMALL groups it is broadcast, so no row moves before the draw;
    more groups are joined.  The shuffle deals copies by a hash of ``shuffle_key`` and sorts each part by it.
    """
    steps = thresholds(rates(docs, weights, group, others))
    if docs.select(group).distinct().limit(SMALL + 1).count() <= SMALL:
        steps = F.broadcast(steps)
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    who = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("|"), F.xxhash64(*hashed).cast("string")))
    added = {k: unused(docs, k) for k in ("steps", "who", "u")}
    steps = steps.withColumnsRenamed({"_g": (g := unused(docs, "group_of_steps")), "_steps": added["steps"]})
    drawn = docs.withColumn(added["who"], who).join(steps, F.col(group).eqNullSafe(F.col(g)))
    drawn = drawn.withColumn(added["u"], uniform(F.concat(F.lit(f"{seed}|"), F.col(added["who"]))))
    keep = [c for c in docs.columns if c not in ("copy", "copies", "shuffle_key")]
    out = drawn.withColumn("copies", below(F.col(added["steps"]), F.col(added["u"]))).where("copies > 0")
    out = out.select(*keep, "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col(added["who"]))
    out = out.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}|order|"), F.col(added["who"]), F.lit("|"), F.col("copy").cast("string")))).drop(added["who"])
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key") if shuffle else out


def oracle(weights: dict[str, float], group: str, seed: str = "mix") -> str:
    cases = " ".join(f"when {group} = '{k}' then {v!r}" for k, v in weights.items())
    rest = max(0.0, 1.0 - sum(weights.values()))
    return f"""
with sizes as (select {group} as g, count(*) as n, case {cases} else 0.0 end::double as w from documents group by {group}),
total as (select sum(n) as a, sum(n) filter (where w = 0) as o from sizes),
rate as (select g, case when w > 0 then w * a / n else {rest!r}::double * a / o end::double as r from sizes, total),
steps as (select g, r, k::bigint as k, exp(k * ln(r) - r - lgamma(k + 1)) as p from rate, lateral (select unnest(range(0, ceil(r + 12 * sqrt(r) + 25)::bigint)) as k) where r > 0),
cdf as (select g, k, sum(p) over (partition by g order by k) as f from steps),
drawn as (select doc_id, {group} as g, (('0x' || substr(md5('{seed}|' || coalesce(cast(doc_id as varchar), '')), 1, 12))::bigint + 0.5) / 281474976710656.0 as u from documents),
counted as (select d.doc_id, d.g, count(*) filter (where c.f < d.u) as copies from drawn d join cdf c on d.g is not distinct from c.g group by d.doc_id, d.g, d.u)
select doc_id, g as {group}, copies::int as copies, copy::int as copy, md5('{seed}|order|' || coalesce(cast(doc_id as varchar), '') || '|' || copy) as shuffle_key
from (select *, unnest(range(0, copies)) as copy from counted where copies > 0)"""
