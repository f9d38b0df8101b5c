"""Screenshots: quality, hashes, pairs that may be duplicates, groups of duplicates, and the best of each group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.scalar import reasons
from framewright.functions.text import ids_fingerprint
from framewright.operators.candidates import by_name
from framewright.operators.semantic import COMPLETION
from framewright.params import DEFAULT, Params

#: Content types that may show the same thing (fixed values).
RELATED = (("WHITEBOARD", "BLACKBOARD", "EQUATION", "DIAGRAM"), ("SLIDE", "DOCUMENT", "DIAGRAM"), ("CODE", "UI_DEMO"))


def quality(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Scores and state from sharpness_raw, brightness_mean, brightness_std, black_ratio, white_ratio and edge_density."""
    mean, std, edge = F.col("brightness_mean"), F.col("brightness_std"), F.col("edge_density")
    one = lambda c: F.least(F.lit(1.0), c)
    blank = ((F.col("black_ratio") > 0.92) | (F.col("white_ratio") > 0.94)) & (edge < 0.01) & (std < 0.08)
    flat = (edge < 0.012) & (std < 0.10)
    under, over = (mean < 0.055) & flat, (mean > 0.96) & flat
    x = rows.withColumns({
        "sharpness_score": one(F.col("sharpness_raw") / p.screenshot_sharpness_reference), "contrast_score": one(std / p.screenshot_contrast_reference), "content_density": one(edge / 0.10 + one(std / 0.20) * 0.25),
        "exposure_score": F.when(under | over, 0.0).otherwise(F.greatest(F.lit(0.35), 1.0 - F.greatest(F.lit(0.0), F.abs(mean - 0.5) - 0.32) * 2.0)), "blankness_score": F.when(blank, 0.0).otherwise(one(0.45 + edge * 7.0 + std * 2.0)),
        "exposure_state": F.when(under, "UNDEREXPOSED").when(over, "OVEREXPOSED").otherwise("NORMAL"), "is_blank": blank,
    })
    w = p.quality_weights
    score = sum((F.col(c) * F.lit(k) for c, k in zip(("sharpness_score", "contrast_score", "exposure_score", "content_density", "blankness_score"), w, strict=True)), F.lit(0.0))
    x = x.withColumn("quality_score", F.greatest(F.lit(0.0), one(score)))
    q = F.col("quality_score")
    state = F.when(F.col("is_blank") | (F.col("exposure_state") != "NORMAL"), "POOR").when((q >= p.screenshot_good_score) & (F.col("sharpness_score") >= p.screenshot_good_sharpness), "GOOD").when(q >= p.screenshot_min_score, "ACCEPTABLE").otherwise("POOR")
    return x.withColumn("quality_state", state)


def search_times(rows: DataFrame, p: Params = DEFAULT, radius: float = 1.0) -> DataFrame:
    """Times to try around each one: itself, then a step before and after, two steps, ..., within the window, up to the cap."""
    k = F.sequence(F.lit(1), F.lit(max(1, int(radius / p.search_step + 1e-9))))
    both = F.flatten(F.transform(k, lambda i: F.array(F.col("timestamp_seconds") - i * p.search_step, F.col("timestamp_seconds") + i * p.search_step)))
    ok = F.filter(both, lambda t: (t >= 0) & (t >= F.col("window_start_seconds") - 1e-6) & (t <= F.col("window_end_seconds") + 1e-6))
    return rows.withColumn("attempts", F.slice(F.concat(F.array("timestamp_seconds"), F.transform(ok, lambda t: F.bround(t, 6))), 1, p.search_max_attempts))


def best_attempt(attempts: DataFrame, p: Params = DEFAULT, radius: float = 1.0, distance_weight: float = 0.1) -> DataFrame:
    """Of the attempts of each candidate (in order ``k``, the first being the exact frame) the one that is kept.

    A later frame replaces the one held if it gains enough on the exact one and, less its distance, beats the one held.
    """
    rows = F.array_sort(F.collect_list(F.struct("k", "timestamp_seconds", "quality_score", "is_blank")))
    x = attempts.groupBy("job_id", "candidate_id").agg(rows.alias("a")).withColumn("first", F.col("a")[0])
    hold = F.struct(F.col("first.quality_score").alias("adjusted"), F.col("first.timestamp_seconds").alias("timestamp_seconds"), F.col("first.quality_score").alias("quality_score"))

    def step(acc: Column, r: Column) -> Column:
        adjusted = r["quality_score"] - distance_weight * F.abs(r["timestamp_seconds"] - F.col("first.timestamp_seconds")) / radius
        good = (r["quality_score"] - F.col("first.quality_score") >= p.search_min_gain) & (adjusted > acc["adjusted"] + 1e-9) & ~r["is_blank"]
        return F.when(good, F.struct(adjusted.alias("adjusted"), r["timestamp_seconds"].alias("timestamp_seconds"), r["quality_score"].alias("quality_score"))).otherwise(acc)

    return x.withColumn("b", F.aggregate(F.slice("a", 2, 1_000), hold, step)).select("job_id", "candidate_id", F.col("b.timestamp_seconds").alias("selected_timestamp_seconds"), F.col("b.quality_score").alias("selected_quality_score"), (F.col("b.timestamp_seconds") - F.col("first.timestamp_seconds")).alias("timestamp_shift_seconds"))


def hamming(a: Column, b: Column) -> Column:
    """Share of bits that differ between two hashes of 16 hexadecimal digits, by halves: 64 bits do not fit a signed number."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("bigint")
    return (F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))) / 64.0


def pairs_in_band(prints: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Pairs of a job within the time band: each row meets those of its bucket and of the bucket before."""
    w = p.duplicate_window
    x = prints.select("job_id", "candidate_id", F.col("selected_timestamp_seconds").alias("t"), F.floor(F.col("selected_timestamp_seconds") / w).alias("bucket"))
    later = x.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1))).withColumnsRenamed({"candidate_id": "c2", "t": "t2"})
    met = x.join(later, ["job_id", "bucket"]).where(((F.col("t2") > F.col("t")) | ((F.col("t2") == F.col("t")) & (F.col("c2") > F.col("candidate_id")))) & (F.col("t2") - F.col("t") <= w))
    return met.select("job_id", F.least("candidate_id", "c2").alias("a"), F.greatest("candidate_id", "c2").alias("b")).distinct()


def pairs_by_slices(prints: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Pairs of a job that share a slice of the hash; slices with more members than the cap say nothing and are left out.

    The cap is the operator's own rule (a common slice is no evidence), and the band covers near pairs without it.
    """
    n = max(1, 16 // p.duplicate_slices)
    x = prints.select("job_id", "candidate_id", F.posexplode(F.array(*[F.substring("phash", i * n + 1, n) for i in range(p.duplicate_slices)])).alias("slice", "part"))
    sizes = x.groupBy("job_id", "slice", "part").agg(F.count("*").alias("n")).where(F.col("n").between(2, p.duplicate_bucket_cap))
    x = x.join(sizes.drop("n"), ["job_id", "slice", "part"])
    other = x.withColumnRenamed("candidate_id", "c2")
    return x.join(other, ["job_id", "slice", "part"]).where("candidate_id < c2").select("job_id", F.col("candidate_id").alias("a"), F.col("c2").alias("b")).distinct()


def pair_keys(prints: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Pairs to compare: all of a small job, else those in the band or sharing a slice."""
    small = prints.groupBy("job_id").agg(F.count("*").alias("n")).where(F.col("n") <= p.duplicate_full_cutoff).select("job_id")
    few = prints.join(small, "job_id").select("job_id", "candidate_id")
    full = few.withColumnRenamed("candidate_id", "a").join(few.withColumnRenamed("candidate_id", "b"), "job_id").where("a < b")
    many = prints.join(small, "job_id", "left_anti")
    return full.unionByName(pairs_in_band(many, p)).unionByName(pairs_by_slices(many, p)).distinct()


def compatibility(a: Column, b: Column) -> Column:
    related = F.lit(False)
    for g in RELATED:
        related = related | (a.isin(*g) & b.isin(*g))
    either = lambda v: (a == v) | (b == v)
    return F.when(a == b, 1.0).when(either("UNKNOWN"), 0.65).when(either("MIXED"), 0.8).when(related, 0.75).otherwise(0.4)


def score_pairs(keys: DataFrame, prints: DataFrame, images: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """Duplicate score, decision and reasons of every pair.

    ``images`` has (job_id, a, b, thumbnail_ssim, edge_similarity, addition_ab, addition_ba): what a kernel found on the
    pictures.  Pairs of the same file need none.
    """
    side = lambda s: prints.select("job_id", F.col("candidate_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("selected_timestamp_seconds", "source_file_sha256", "phash", "dhash", "content_type")])
    x = keys.join(side("a"), ["job_id", "a"]).join(side("b"), ["job_id", "b"])
    if images is not None:
        x = x.join(images, ["job_id", "a", "b"], "left")
    same = F.col("a_source_file_sha256") == F.col("b_source_file_sha256")
    gap = F.abs(F.col("a_selected_timestamp_seconds") - F.col("b_selected_timestamp_seconds"))
    near = gap <= p.duplicate_window
    x = x.withColumns({
        "timestamp_gap_seconds": gap, "phash_distance": F.when(same, 0.0).otherwise(hamming(F.col("a_phash"), F.col("b_phash"))), "dhash_distance": F.when(same, 0.0).otherwise(hamming(F.col("a_dhash"), F.col("b_dhash"))),
        "content_compatibility_score": F.when(same, 1.0).otherwise(compatibility(F.col("a_content_type"), F.col("b_content_type"))), "addition": F.when(same, 0.0).otherwise(F.greatest("addition_ab", "addition_ba")),
        "thumbnail_ssim": F.when(same, 1.0).otherwise(F.col("thumbnail_ssim")), "edge_similarity": F.when(same, 1.0).otherwise(F.col("edge_similarity")), "_same": same,
    })
    time = F.when(near, F.greatest(F.lit(0.0), 1.0 - gap / max(p.duplicate_window, 1e-9))).otherwise(0.15)
    terms = (F.col("thumbnail_ssim"), F.col("edge_similarity"), 1.0 - F.col("phash_distance"), 1.0 - F.col("dhash_distance"), F.col("content_compatibility_score"), time)
    score = sum((t * F.lit(w) for t, w in zip(terms, p.duplicate_weights, strict=True)), F.lit(0.0))
    x = x.withColumn("duplicate_score", F.when(F.col("_same"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))
    added = F.col("addition") > p.duplicate_max_addition
    like = (F.col("thumbnail_ssim") >= p.duplicate_min_structure) & (F.col("edge_similarity") >= p.duplicate_min_edge) & ~added
    what = F.when(F.col("_same") | ((F.col("duplicate_score") >= p.duplicate_score) & like), "DUPLICATE").when((F.col("duplicate_score") >= p.possible_duplicate_score) | ((F.col("phash_distance") <= p.duplicate_long_range_phash) & (F.col("thumbnail_ssim") >= 0.80)), "POSSIBLE_DUPLICATE").otherwise("DISTINCT")
    why = reasons(
        (F.col("phash_distance") <= 0.08, "VERY_LOW_PHASH_DISTANCE"), (F.col("dhash_distance") <= 0.10, "VERY_LOW_DHASH_DISTANCE"), (F.col("thumbnail_ssim") >= p.duplicate_min_structure, "HIGH_STRUCTURAL_SIMILARITY"), (F.col("edge_similarity") >= p.duplicate_min_edge, "HIGH_EDGE_SIMILARITY"),
        (added, "MEANINGFUL_STRUCTURAL_ADDITION"), (F.col("content_compatibility_score") < 0.5, "CONTENT_TYPE_MISMATCH"), (near, "TEMPORALLY_ADJACENT"), (~near, "LONG_RANGE_HASH_MATCH"),
    )
    x = x.withColumn("reason_codes", F.when(F.col("_same"), F.array(F.lit("IDENTICAL_FILE_SHA"))).otherwise(why)).withColumn("decision", what)
    return x.select("job_id", "a", "b", "timestamp_gap_seconds", "phash_distance", "dhash_distance", "thumbnail_ssim", "edge_similarity", "content_compatibility_score", "duplicate_score", "decision", "reason_codes")


def complete_linkage(members: list, linked: set) -> list[list]:
    """Members in their order; each joins the first group with all of which it is linked."""
    groups: list[list] = []
    for m in members:
        for g in groups:
            if all((min(m, o), max(m, o)) in linked for o in g):
                g.append(m)
                break
        else:
            groups.append([m])
    return groups


def duplicate_groups(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """(job_id, candidate_id, group_id, group_size): greedy complete linkage in time order, so chains do not merge.

    Each placement depends on those before it: a Python group for each job's members and duplicate pairs.
    """
    dup = pairs.where("decision = 'DUPLICATE'").select("job_id", "a", "b")
    left = prints.select("job_id", "candidate_id", "selected_timestamp_seconds")

    def one(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"job_id": [], "candidate_id": [], "first": [], "members": []})
        order = rows.sort_values(["selected_timestamp_seconds", "candidate_id"])["candidate_id"].tolist()
        groups = complete_linkage(order, set(zip(links["a"], links["b"], strict=True)))
        return pd.DataFrame([(rows["job_id"].iloc[0], m, g[0], g) for g in groups for m in g], columns=["job_id", "candidate_id", "first", "members"])

    got = left.groupBy("job_id").cogroup(dup.groupBy("job_id")).applyInPandas(one, "job_id string, candidate_id bigint, first bigint, members array<bigint>")
    gid = F.concat(F.lit("dup_"), F.substring(ids_fingerprint(F.col("members")), 1, 12))
    return got.select("job_id", "candidate_id", gid.alias("group_id"), F.col("first").alias("representative_candidate_id"), F.size("members").alias("group_size"))


def final_selection(members: DataFrame, p: Params = DEFAULT, radius: float = 1.0) -> DataFrame:
    """The winner of every group among members with group_id, semantic_decision_score, quality_score, completion_state, confidence, sharpness_score, timestamp_shift_seconds, timestamp_seconds and quality_state.

    Quality cannot outweigh a candidate that is much stronger in meaning: only those within the deficit of the strongest run.
    """
    shift = F.abs(F.col("timestamp_shift_seconds"))
    ok = (F.col("quality_state") != "INVALID") & (F.col("completion_state") != "TRANSITION")
    x = members.withColumns({"eligible": ok, "completion_score": by_name(F.col("completion_state"), COMPLETION), "proximity": F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), shift / max(radius, 1e-9))), "exact": (shift < 1e-7).cast("int")})
    terms = ("semantic_decision_score", "quality_score", "completion_score", "confidence", "sharpness_score", "proximity")
    score = sum((F.col(c) * F.lit(w) for c, w in zip(terms, p.final_weights, strict=True)), F.lit(0.0)) + F.col("exact") * F.lit(p.final_exact_bonus)
    x = x.withColumn("final_selection_score", F.when(F.col("eligible"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0))
    g = Window.partitionBy("job_id", "group_id")
    top = F.max(F.when(F.col("eligible"), F.col("semantic_decision_score"))).over(g)
    runs = F.col("eligible") & (top - F.col("semantic_decision_score") <= p.final_semantic_deficit + p.final_epsilon)
    x = x.withColumn("_runs", runs)
    keys = [F.desc("_runs"), F.round(F.col("final_selection_score") / p.final_epsilon).desc()] + [F.desc(c) for c in ("semantic_decision_score", "quality_score", "completion_score", "sharpness_score", "proximity", "exact", "confidence")] + [F.asc("timestamp_seconds"), F.asc("candidate_id")]
    first = F.row_number().over(g.orderBy(*keys)) == 1
    what = F.when(~F.col("eligible"), "INELIGIBLE").when(first & F.col("_runs"), "WINNER").otherwise("DUPLICATE_SUPPRESSED")
    return x.withColumn("decision", what).drop("_runs", "exact")
