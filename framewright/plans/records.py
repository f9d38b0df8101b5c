"""Queries over screenshots, pages, texts, evaluation and lineage, each over whole tables seen in that role."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import text as T
from framewright.operators import documents, evaluation, lineage, screenshots
from framewright.params import DEFAULT as P
from framewright.plans.adapters import frames, table
from framewright.plans.oracle import r6 as sql6
from framewright.plans.oracle import rounded, step
from framewright.plans.speech import judged
from framewright.plans.visual import Visual
from framewright.operators.semantic import COMPLETION, decide
from framewright.queries import register, show
from framewright.sources import media
from framewright.sources.tables import keep


def add(name, build, columns, numbers="", source=None):
    register(name, lambda spark, sf: show(build(spark, sf), columns, numbers), rounded(columns, source, numbers) if source else None)


# -- screenshots: a frame's picture, and a vector's signs as hashes ----------------------------------------------------
def shots(spark, sf):
    f = frames(spark, sf).where("is_valid")
    return f.select("job_id", "index", F.col("sharpness_score").alias("sharpness_raw"), F.col("brightness").alias("brightness_mean"), (F.col("contrast") / 2.0).alias("brightness_std"), F.col("black_pixel_ratio").alias("black_ratio"), F.when(F.col("level") > 0.9, 1.0).otherwise(0.0).alias("white_ratio"), "edge_density")


step("sh0", "select job_id, index, sharpness_score as sr, brightness as m, contrast / 2.0::double as s, black_pixel_ratio as b, case when level > 0.9::double then 1.0::double else 0.0::double end as w, edge_density as e from fr where is_valid")
step("sh1", f"""select *, least(1.0::double, sr / {P.screenshot_sharpness_reference}::double) as sharpness_score, least(1.0::double, s / {P.screenshot_contrast_reference}::double) as contrast_score, least(1.0::double, e / 0.10::double + least(1.0::double, s / 0.20::double) * 0.25::double) as content_density, (b > 0.92::double or w > 0.94::double) and e < 0.01::double and s < 0.08::double as is_blank,
  case when m < 0.055::double and e < 0.012::double and s < 0.10::double then 'UNDEREXPOSED' when m > 0.96::double and e < 0.012::double and s < 0.10::double then 'OVEREXPOSED' else 'NORMAL' end as exposure_state from sh0""")
step("sh2", f"""select *, greatest(0.0::double, least(1.0::double, 0.0::double + sharpness_score * {P.quality_weights[0]}::double + contrast_score * {P.quality_weights[1]}::double + case when exposure_state <> 'NORMAL' then 0.0::double else greatest(0.35::double, 1.0::double - greatest(0.0::double, abs(m - 0.5::double) - 0.32::double) * 2.0::double) end * {P.quality_weights[2]}::double
  + content_density * {P.quality_weights[3]}::double + case when is_blank then 0.0::double else least(1.0::double, 0.45::double + e * 7.0::double + s * 2.0::double) end * {P.quality_weights[4]}::double)) as quality_score from sh1""")
step("sh", f"select *, case when is_blank or exposure_state <> 'NORMAL' then 'POOR' when quality_score >= {P.screenshot_good_score}::double and sharpness_score >= {P.screenshot_good_sharpness}::double then 'GOOD' when quality_score >= {P.screenshot_min_score}::double then 'ACCEPTABLE' else 'POOR' end as quality_state from sh2")
add("screenshot_quality", lambda spark, sf: screenshots.quality(shots(spark, sf), P), "job_id, index, exposure_state, is_blank, quality_state", "sharpness_score, content_density, quality_score", "sh")

TYPES = ["SLIDE", "WHITEBOARD", "BLACKBOARD", "CODE", "DIAGRAM", "EQUATION", "DOCUMENT", "UI_DEMO", "MIXED", "UNKNOWN"]


def prints(spark, sf):
    """Vectors as screenshots: signs give one hash, rises the other; a label is a job, and a vector's place is its time."""
    hexed = lambda bits: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.lower(F.hex(F.aggregate(F.slice(bits, i * 4 + 1, 4), F.lit(0), lambda a, b: a * 2 + b)))), "")
    v = table(spark, sf, "embeddings").where(F.size("embedding") == 64).select(F.col("label").cast("string").alias("job_id"), F.col("vec_id").alias("candidate_id"), (F.col("vec_id") * 2.0).alias("selected_timestamp_seconds"), "embedding", "label")
    signs = F.transform("embedding", lambda x: (x > 0).cast("int"))
    rises = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.element_at("embedding", F.when(i == 64, 1).otherwise(i + 1)) > F.element_at("embedding", i)).cast("int"))
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("candidate_id") % 10 + 1).cast("int"))
    return v.select("job_id", "candidate_id", "selected_timestamp_seconds", hexed(signs).alias("phash"), hexed(rises).alias("dhash"), kind.alias("content_type"), F.concat(F.lit("sha"), F.col("candidate_id").cast("string")).alias("source_file_sha256"))


_bits = lambda cond: "list_aggregate(list_transform(range(1, 17), lambda i: format('{:x}', " + " + ".join(f"({cond.format(f'((i - 1) * 4 + {k})')})::int * {8 >> (k - 1)}" for k in range(1, 5)) + ")), 'string_agg', '')"
step("fp", f"""select cast(label as varchar) as job_id, vec_id as candidate_id, vec_id * 2.0::double as selected_timestamp_seconds, {_bits('embedding[{0}] > 0')} as phash, {_bits('embedding[({0}) % 64 + 1] > embedding[{0}]')} as dhash,
  {TYPES!r}[vec_id % 10 + 1] as content_type from embeddings where len(embedding) = 64""")
add("fingerprints", prints, "job_id, candidate_id, phash, dhash, content_type", "", "fp")
step("bd", f"select a.job_id, least(a.candidate_id, b.candidate_id) as a, greatest(a.candidate_id, b.candidate_id) as b from fp a join fp b on a.job_id = b.job_id and a.candidate_id < b.candidate_id and abs(b.selected_timestamp_seconds - a.selected_timestamp_seconds) <= {P.duplicate_window}::double")
add("pair_keys_band", lambda spark, sf: screenshots.pairs_in_band(keep(prints(spark, sf)), P), "job_id, a, b", "", "bd")
step("sl", f"select *, count(*) over (partition by job_id, i, part) as n from (select job_id, candidate_id, i, substr(phash, (i * 4 + 1)::int, 4) as part from (select *, unnest(range(0, {P.duplicate_slices})) as i from fp))")
step("lsh", f"select distinct a.job_id, a.candidate_id as a, b.candidate_id as b from sl a join sl b on a.job_id = b.job_id and a.i = b.i and a.part = b.part and a.candidate_id < b.candidate_id where a.n <= {P.duplicate_bucket_cap}")
add("pair_keys_lsh", lambda spark, sf: screenshots.pairs_by_slices(keep(prints(spark, sf)), P), "job_id, a, b", "", "lsh")


def scored_pairs(spark, sf):
    p = keep(prints(spark, sf))
    keys = screenshots.pair_keys(p, P)
    images = keys.select("job_id", "a", "b", (1.0 - (F.col("a") * 7 + F.col("b")) % 40 / 100.0).alias("thumbnail_ssim"), (1.0 - (F.col("a") + F.col("b") * 3) % 50 / 100.0).alias("edge_similarity"), ((F.col("a") + F.col("b")) % 45 / 100.0).alias("addition_ab"), (F.col("b") % 30 / 100.0).alias("addition_ba"))
    return screenshots.score_pairs(keys, p, images, P)


step("sm", f"select job_id from fp group by job_id having count(*) <= {P.duplicate_full_cutoff}")
step("pk", """select a.job_id, a.candidate_id as a, b.candidate_id as b from fp a join fp b on a.job_id = b.job_id and a.candidate_id < b.candidate_id where a.job_id in (select job_id from sm)
  union select * from bd where job_id not in (select job_id from sm) union select * from lsh where job_id not in (select job_id from sm)""")
add("pair_keys", lambda spark, sf: screenshots.pair_keys(keep(prints(spark, sf)), P), "job_id, a, b", "", "pk")
_ham = lambda c: f"bit_count(xor(('0x' || a.{c})::ubigint, ('0x' || b.{c})::ubigint)) / 64.0::double"
_rel = " or ".join(f"(a.content_type in {g!r} and b.content_type in {g!r})" for g in screenshots.RELATED)
step("ps0", f"""select k.job_id, k.a, k.b, abs(a.selected_timestamp_seconds - b.selected_timestamp_seconds) as timestamp_gap_seconds, {_ham('phash')} as phash_distance, {_ham('dhash')} as dhash_distance, 1.0::double - (k.a * 7 + k.b) % 40 / 100.0::double as ss, 1.0::double - (k.a + k.b * 3) % 50 / 100.0::double as es, greatest((k.a + k.b) % 45 / 100.0::double, k.b % 30 / 100.0::double) as ad,
  case when a.content_type = b.content_type then 1.0::double when 'UNKNOWN' in (a.content_type, b.content_type) then 0.65::double when 'MIXED' in (a.content_type, b.content_type) then 0.8::double when {_rel} then 0.75::double else 0.4::double end as content_compatibility_score
from pk k join fp a on a.job_id = k.job_id and a.candidate_id = k.a join fp b on b.job_id = k.job_id and b.candidate_id = k.b""")
_dw = P.duplicate_weights
step("ps1", f"select *, greatest(0.0::double, least(1.0::double, 0.0::double + ss * {_dw[0]}::double + es * {_dw[1]}::double + (1.0::double - phash_distance) * {_dw[2]}::double + (1.0::double - dhash_distance) * {_dw[3]}::double + content_compatibility_score * {_dw[4]}::double + case when timestamp_gap_seconds <= {P.duplicate_window}::double then greatest(0.0::double, 1.0::double - timestamp_gap_seconds / {P.duplicate_window}::double) else 0.15::double end * {_dw[5]}::double)) as duplicate_score from ps0")
step("ps", f"""select *, case when duplicate_score >= {P.duplicate_score}::double and ss >= {P.duplicate_min_structure}::double and es >= {P.duplicate_min_edge}::double and not ad > {P.duplicate_max_addition}::double then 'DUPLICATE' when duplicate_score >= {P.possible_duplicate_score}::double or (phash_distance <= {P.duplicate_long_range_phash}::double and ss >= 0.80::double) then 'POSSIBLE_DUPLICATE' else 'DISTINCT' end as decision,
  list_filter([case when phash_distance <= 0.08::double then 'VERY_LOW_PHASH_DISTANCE' end, case when dhash_distance <= 0.10::double then 'VERY_LOW_DHASH_DISTANCE' end, case when ss >= {P.duplicate_min_structure}::double then 'HIGH_STRUCTURAL_SIMILARITY' end, case when es >= {P.duplicate_min_edge}::double then 'HIGH_EDGE_SIMILARITY' end, case when ad > {P.duplicate_max_addition}::double then 'MEANINGFUL_STRUCTURAL_ADDITION' end,
  case when content_compatibility_score < 0.5::double then 'CONTENT_TYPE_MISMATCH' end, case when timestamp_gap_seconds <= {P.duplicate_window}::double then 'TEMPORALLY_ADJACENT' else 'LONG_RANGE_HASH_MATCH' end], lambda x: x is not null) as reason_codes from ps1""")
add("pair_scores", scored_pairs, "job_id, a, b, decision, reason_codes", "timestamp_gap_seconds, phash_distance, dhash_distance, content_compatibility_score, duplicate_score", "ps")
register("duplicate_groups", lambda spark, sf: screenshots.duplicate_groups(keep(prints(spark, sf)), scored_pairs(spark, sf)))


def members(spark, sf):
    """Kept candidates of the visual chain, five in time to a group."""
    d = keep(decide(judged(Visual.over(spark, sf)), P))
    return d.select("job_id", "candidate_id", F.floor(F.col("candidate_id") / 5).cast("bigint").alias("group_id"), "semantic_decision_score", "ranking_score", "completion_state", "confidence", ((F.col("candidate_id") * 29 % 100) / 100.0).alias("quality_score"), ((F.col("candidate_id") * 17 % 100) / 100.0).alias("sharpness_score"), ((F.col("candidate_id") % 3) * 0.5).alias("timestamp_shift_seconds"), (F.col("candidate_id") * 2.0).alias("timestamp_seconds"), F.lit("GOOD").alias("quality_state"))


_fw = P.final_weights
_cm = "case cs " + " ".join(f"when '{k}' then {v}::double" for k, v in COMPLETION.items()) + " end"
step("fs0", f"""select job_id, candidate_id, floor(candidate_id / 5)::bigint as group_id, semantic_decision_score as sd, confidence, {_cm} as comp, (candidate_id * 29 % 100) / 100.0::double as q, (candidate_id * 17 % 100) / 100.0::double as sp, (candidate_id % 3) * 0.5::double as shift, candidate_id * 2.0::double as t, cs <> 'TRANSITION' as eligible from de""")
step("fs1", f"""select *, greatest(0.0::double, 1.0::double - least(1.0::double, shift)) as px, (shift < 1e-7::double)::int as ex, case when eligible then greatest(0.0::double, least(1.0::double, 0.0::double + sd * {_fw[0]}::double + q * {_fw[1]}::double + comp * {_fw[2]}::double + confidence * {_fw[3]}::double + sp * {_fw[4]}::double + greatest(0.0::double, 1.0::double - least(1.0::double, shift)) * {_fw[5]}::double + (shift < 1e-7::double)::int * {P.final_exact_bonus}::double)) else 0.0::double end as final_selection_score,
  max(sd) filter (where eligible) over (partition by job_id, group_id) as top from fs0""")
step("fs2", f"select *, eligible and top - sd <= {P.final_semantic_deficit + P.final_epsilon!r}::double as runs from fs1")
step("fs", f"""select *, case when not eligible then 'INELIGIBLE' when runs and row_number() over (partition by job_id, group_id order by coalesce(runs, false) desc, round(final_selection_score / {P.final_epsilon!r}::double) desc, sd desc, q desc, comp desc, sp desc, px desc, ex desc, confidence desc, t, candidate_id) = 1 then 'WINNER' else 'DUPLICATE_SUPPRESSED' end as decision from fs2""")
add("final_selection", lambda spark, sf: screenshots.final_selection(members(spark, sf), P), "job_id, candidate_id, group_id, decision", "final_selection_score", "fs")

# -- pages and texts -------------------------------------------------------------------------------------------------------
def items(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("source").alias("job_id"), F.col("doc_id").alias("order"), (F.col("n_chars") % 1280 + 320).alias("width"), (F.col("doc_id") % 800 + 300).alias("height"))


_mm = documents.points
_m, _f, _cp = _mm(P.margin_mm), _mm(P.footer_mm), _mm(P.caption_mm)
_pw, _ph = (_mm(x) for x in documents.PAGES["A4"])
step("it", "select source as job_id, doc_id as \"order\", n_chars % 1280 + 320 as width, doc_id % 800 + 300 as height from documents")
step("pg0", f"select *, case when abs(width / height - 1.0::double) <= {P.square_tolerance}::double then 'SQUARE' when width / height > 1.0::double then 'LANDSCAPE' else 'PORTRAIT' end as orientation from it")
step("pg1", f"select *, case when orientation = 'LANDSCAPE' then 'LANDSCAPE' else 'PORTRAIT' end as page_orientation, case when orientation = 'LANDSCAPE' then {_ph!r}::double else {_pw!r}::double end as page_width, case when orientation = 'LANDSCAPE' then {_pw!r}::double else {_ph!r}::double end as page_height from pg0")
step("pg2", f"select *, page_width - {2 * _m!r}::double as uw, page_height - {2 * _m!r}::double - {_f!r}::double - {_cp!r}::double as uh from pg1")
step("pg", f"""select *, width * scale as image_width, height * scale as image_height, {_m!r}::double + (uw - width * scale) / 2.0::double as image_x, {_m!r}::double + (uh - height * scale) / 2.0::double as image_y, {_m!r}::double + uh as caption_y, page_height - {_m!r}::double - {_f!r}::double as footer_y, (width * scale) * (height * scale) / (uw * uh) as utilization from (select *, least(least(uw / width, uh / height), 1.0::double) as scale from pg2)""")
add("page_layout", lambda spark, sf: documents.page_layout(items(spark, sf), P), "job_id, order, orientation, page_orientation".replace("order,", "`order`,"), "page_width, page_height, scale, image_width, image_height, image_x, image_y, caption_y, footer_y, utilization")
from framewright.queries import ORACLE_SQL  # noqa: E402
from framewright.plans.oracle import chain  # noqa: E402

ORACLE_SQL["page_layout"] = chain('select job_id, "order", orientation, page_orientation, ' + ", ".join(f"{sql6(c)} as {c}" for c in "page_width page_height scale image_width image_height image_x image_y caption_y footer_y utilization".split()) + " from pg")
step("pgs", "select job_id, count(*) as page_count, count(*) filter (where page_orientation = 'PORTRAIT') as portrait_pages, count(*) filter (where page_orientation = 'LANDSCAPE') as landscape_pages, count(distinct (width, height)) as resolutions, avg(scale) as mean_scale, min(scale) as min_scale, avg(utilization) as mean_utilization, quantile_cont(utilization, 0.5) as median_utilization from pg group by job_id")
add("layout_stats", lambda spark, sf: documents.layout_stats(documents.page_layout(items(spark, sf), P)), "job_id, page_count, portrait_pages, landscape_pages, resolutions", "mean_scale, min_scale, mean_utilization, median_utilization", "pgs")
register("result_page", lambda spark, sf: documents.page(table(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey")], 100, 50), "select o_orderkey from orders order by o_orderkey limit 50 offset 100")
register("timestamp_display", lambda spark, sf: table(spark, sf, "documents").select("doc_id", T.clock(F.col("n_chars") * 1.5).alias("display")), "select doc_id, case when s >= 3600 then (case when s // 3600 < 100 then lpad((s // 3600)::varchar, 2, '0') else (s // 3600)::varchar end) || ':' else '' end || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') as display from (select doc_id, trunc(n_chars * 1.5)::bigint as s from documents)")
register("word_count", lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", T.word_count(F.col("text")).cast("bigint").alias("words")), "select conv_id, turn, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::bigint as words from conversations")
register("caption_truncate", lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", T.truncate(F.col("text"), P.caption_max_characters, P.caption_max_words).alias("caption")), rf"""
with w as (select conv_id, turn, list_filter(string_split_regex(nfc_normalize(text), '\s+'), lambda x: x <> '') as l from conversations), f as (select *, array_to_string(l[1:{P.caption_max_words}], ' ') as few from w),
o as (select *, length(few) > {P.caption_max_characters} as over, rtrim(substr(few, 1, {P.caption_max_characters})) as cut from f), r as (select *, case when over then (case when instr(cut, ' ') > 0 then regexp_replace(cut, ' [^ ]*$', '') else cut end) else few end as res from o)
select conv_id, turn, case when (len(l) > {P.caption_max_words} or over) and length(res) > 0 then regexp_replace(res, '[ .,…]+$', '') || '…' else res end as caption from r""")
register("safe_filename", lambda spark, sf: table(spark, sf, "pages").select("page_id", T.filename(F.col("url"), P.filename_max_length).alias("name")), rf"""
select page_id, regexp_replace(substr(regexp_replace(case when t = '' then 'lecture-notes' else t end, '(?i)\.pdf$', ''), 1, {P.filename_max_length}), '[-._ ]+$', '') || '.pdf' as name from (
select page_id, regexp_replace(regexp_replace(regexp_replace(translate(trim(regexp_replace(nfc_normalize(url), '\s+', ' ', 'g')), '/\', '  '), '[^\w\- .()]+', '', 'g'), '\s+', '-', 'g'), '^[-._ ]+|[-._ ]+$', '', 'g') as t from pages)""")
register("exact_texts", lambda spark, sf: table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "select sha256(text) as sha256, count(*) as n, min(doc_id) as first from documents group by 1")


# -- evaluation, limits, lineage ---------------------------------------------------------------------------------------------
def truth(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("sample_id"), "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    s = e.where("event_type = 'purchase'").select("sample_id", F.col("event_id").cast("string").alias("state_id"), F.col("t").alias("target_timestamp_seconds"), (F.col("t") - 3600.0).alias("acceptable_start_seconds"), (F.col("t") + 3600.0).alias("acceptable_end_seconds"), F.when(F.col("event_id") % 2 == 0, "OPTIONAL").otherwise("REQUIRED").alias("importance"), F.lit(None).cast("string").alias("duplicate_group"), F.lit(None).cast("string").alias("acceptable_equivalence_group"))
    level = F.explode(F.array(*[F.lit(x) for x in evaluation.STAGES[:3]]))
    p = e.where("event_type = 'click'").select("sample_id", level.alias("level"), "event_id", F.col("event_id").cast("string").alias("prediction_id"), F.col("t").alias("timestamp_seconds"))
    p = p.where((F.col("level") == "CANDIDATE") | ((F.col("level") == "SEMANTIC") & (F.col("event_id") % 3 != 0)) | ((F.col("level") == "FINAL_SCREENSHOT") & (F.col("event_id") % 5 < 3))).drop("event_id")
    n = e.where("event_type = 'error'").select("sample_id", (F.col("t") - 600.0).alias("start_seconds"), (F.col("t") + 600.0).alias("end_seconds"))
    return keep(s), keep(p), n


def evaluated(spark, sf):
    s, p, n = truth(spark, sf)
    return evaluation.summarize(evaluation.temporal_match(s, p), s, p, n)


register("temporal_match", lambda spark, sf: evaluation.temporal_match(*truth(spark, sf)[:2]))
register("metric_summary", evaluated)
register("metrics_micro_macro", lambda spark, sf: evaluation.aggregate(evaluated(spark, sf), "level"))
register("loss_funnel", lambda spark, sf: (lambda s, p, n: evaluation.loss_funnel(evaluation.temporal_match(s, p), s))(*truth(spark, sf)))


def runs(spark, sf):
    o = table(spark, sf, "orders")
    x = lambda k, m: ((F.col("o_orderkey") * k) % m).cast("bigint")
    return o.select(F.col("o_orderkey").alias("run_id"), (x(7, 100) / 100.0).alias("base_recall"), (x(7, 100) / 100.0 + (x(11, 9) - 4) / 1000.0).alias("cand_recall"), (x(13, 100) / 100.0).alias("base_precision"), (x(13, 100) / 100.0 + (x(5, 50) - 25) / 1000.0).alias("cand_precision"), (x(3, 100) / 100.0).alias("base_f1"), (x(3, 100) / 100.0 + (x(17, 9) - 4) / 1000.0).alias("cand_f1"), F.when(x(1, 10) == 0, 1).otherwise(0).alias("new_required_misses"), F.when(x(1, 17) == 0, 1).otherwise(0).alias("new_critical_failures"),
                    x(19, 500).alias("base_runtime"), x(23, 500).alias("cand_runtime"), x(29, 1000).alias("base_peak"), x(31, 1000).alias("cand_peak"), x(37, 1000).alias("base_disk"), x(41, 1000).alias("cand_disk"), x(43, 14400).alias("duration_seconds"), x(47, 1200).alias("candidates"), x(53, 1200).alias("pdf_pages"))


_x = lambda k, m: f"(o_orderkey * {k} % {m})"
step("ru", f"""select o_orderkey as run_id, {_x(7, 100)} / 100.0::double as br, {_x(7, 100)} / 100.0::double + ({_x(11, 9)} - 4) / 1000.0::double as cr, {_x(13, 100)} / 100.0::double as bp, {_x(13, 100)} / 100.0::double + ({_x(5, 50)} - 25) / 1000.0::double as cp, {_x(3, 100)} / 100.0::double as bf, {_x(3, 100)} / 100.0::double + ({_x(17, 9)} - 4) / 1000.0::double as cf,
  {_x(1, 10)} = 0 as miss, {_x(1, 17)} = 0 as crit, {_x(19, 500)} as b1, {_x(23, 500)} as c1, {_x(29, 1000)} as b2, {_x(31, 1000)} as c2, {_x(37, 1000)} as b3, {_x(41, 1000)} as c3, {_x(43, 14400)} as duration_seconds, {_x(47, 1200)} as candidates, {_x(53, 1200)} as pdf_pages from orders""")
step("cg", "select run_id, case when (cr - br >= 0.0025::double or cf - bf >= 0.0025::double) and cp - bp >= -0.01::double and not miss and not crit then 'ACCEPT' when miss or crit then 'REJECT' else 'MANUAL_REVIEW' end as recommendation, cr - br as recall_delta, cp - bp as precision_delta, cf - bf as f1_delta from ru")
add("calibration_gate", lambda spark, sf: evaluation.calibration_gate(runs(spark, sf)), "run_id, recommendation", "recall_delta, precision_delta, f1_delta", "cg")
step("pf", "select *, g >= 0.03::double and m <= 0.20::double and d <= 0.20::double as accepted, g as runtime_improvement_ratio, m as memory_regression_ratio, d as disk_regression_ratio from (select run_id, case when b1 = 0 then -0.0::double else -(c1 - b1) / b1::double end as g, case when b2 = 0 then 0.0::double else (c2 - b2) / b2::double end as m, case when b3 = 0 then 0.0::double else (c3 - b3) / b3::double end as d from ru)")
add("performance_gate", lambda spark, sf: evaluation.performance_gate(runs(spark, sf)), "run_id, accepted", "runtime_improvement_ratio, memory_regression_ratio, disk_regression_ratio", "pf")
LIMITS = {"duration_seconds": (10_800, True), "candidates": (1000, True), "pdf_pages": (1000, False)}
step("ls", "select run_id, case when duration_seconds > 10800 or candidates > 1000 then 'LIMIT_EXCEEDED' when pdf_pages > 1000 then 'PASS_WITH_WARNINGS' else 'PASS' end as status, list_filter([case when duration_seconds > 10800 then 'DURATION_SECONDS' end, case when candidates > 1000 then 'CANDIDATES' end], lambda x: x is not null) as failed_limits, list_filter([case when pdf_pages > 1000 then 'PDF_PAGES_EXCEEDED' end], lambda x: x is not null) as warnings from ru")
add("limit_status", lambda spark, sf: evaluation.limit_status(runs(spark, sf), LIMITS), "run_id, status, failed_limits, warnings", "", "ls")
register("scaling_class", lambda spark, sf: runs(spark, sf).select("run_id", evaluation.scaling_class(F.col("base_runtime") / 100.0, F.col("cand_runtime") / 100.0).alias("scaling")), chain("select run_id, case when b1 / 100.0::double <= 1 then 'UNKNOWN' when (c1 / 100.0::double) / (b1 / 100.0::double) < 0.75::double then 'SUBLINEAR' when (c1 / 100.0::double) / (b1 / 100.0::double) <= 1.35::double then 'APPROX_LINEAR' when (c1 / 100.0::double) / (b1 / 100.0::double) <= 2.5::double then 'SUPERLINEAR' else 'EXPLOSIVE' end as scaling from ru"))
register("release_readiness", lambda spark, sf: evaluation.release_readiness(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("release"), F.col("l_linenumber").alias("gate_id"), (F.col("l_linenumber") <= 2).alias("required"), (F.col("l_quantity") > 5).alias("ok"))).select("release", "readiness"), "select l_orderkey as release, case when bool_or(l_linenumber <= 2 and not l_quantity > 5) then 'NOT_READY' when bool_or(l_linenumber > 2 and not l_quantity > 5) then 'READY_WITH_WARNINGS' else 'READY' end as readiness from lineitem group by 1")


def validity(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    base = li.select(F.col("l_orderkey").cast("string").alias("job_id"), F.concat(F.lit("PHASE_"), F.col("l_linenumber").cast("string")).alias("stage"), F.col("l_linenumber").cast("bigint").alias("stage_order"), F.col("l_partkey").alias("config_fp"), F.col("l_suppkey").alias("upstream_fp"))
    s = base.withColumns({"config_fp": F.when(F.col("config_fp") % 7 == 0, -1).otherwise(F.col("config_fp")), "artifact_fp": F.col("upstream_fp"), "actual_fp": F.when(F.col("upstream_fp") % 9 == 0, -1).otherwise(F.col("upstream_fp")), "checkpoint": F.col("config_fp") % 5 != 0})
    return lineage.stage_validity(base, s)


step("vl", "select cast(l_orderkey as varchar) as job_id, 'PHASE_' || l_linenumber as stage, l_linenumber::bigint as stage_order, case when l_partkey % 5 = 0 then 'MISSING' when l_suppkey % 9 = 0 then 'CORRUPT' when l_partkey % 7 = 0 then 'STALE' else 'VALID' end as state from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem group by 1, 2)")
add("stage_validity", validity, "job_id, stage, state", "", "vl")
step("rp", "select job_id, max(stage) filter (where ok) as last_valid_stage, min(stage) filter (where not ok) as resume_stage, coalesce(list(stage order by stage_order) filter (where not ok), []::varchar[]) as stages_to_clear from (select *, bool_and(state = 'VALID') over (partition by job_id order by stage_order rows between unbounded preceding and current row) as ok from vl) group by job_id")
add("recovery_plan", lambda spark, sf: lineage.resume_plan(keep(validity(spark, sf))), "job_id, last_valid_stage, resume_stage, stages_to_clear", "", "rp")


def cache_of(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("fingerprint"))
    old = o.where(F.col("id") % 4 != 0).withColumn("fingerprint", F.when(F.col("id") % 6 == 1, -1).otherwise(F.col("fingerprint")))
    return o, old.unionByName(o.where((F.col("id") % 100 == 0) & (F.col("id") > 0)).select((-F.col("id")).alias("id"), "fingerprint"))


register("missing_rows_incremental", lambda spark, sf: (lambda i, c: lineage.rows_to_make(i, c, ["id"]))(*cache_of(spark, sf)), "select o_orderkey as id, o_custkey as fingerprint from orders where o_orderkey % 4 = 0 or o_orderkey % 6 = 1")
register("orphans", lambda spark, sf: (lambda i, c: lineage.orphans(c, i, ["id"]))(*cache_of(spark, sf)), "select -o_orderkey as id, o_custkey as fingerprint from orders where o_orderkey % 100 = 0 and o_orderkey > 0")
register("duplicate_ids", lambda spark, sf: lineage.repeated_ids(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"]), "select l_orderkey, l_partkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def flat_secrets(spark, sf):
    m = T.redact(F.create_map(F.lit("api_key"), F.lit("k"), F.col("event_type"), F.col("props")))
    return table(spark, sf, "events").select("event_id", m["api_key"].alias("hidden"), F.element_at(m, F.col("event_type")).alias("shown"))


register("redaction", flat_secrets, "select event_id, '***REDACTED***' as hidden, props as shown from events")


def secrets(spark, sf):
    """JSON with sensitive names at three depths, and in a list."""
    e = table(spark, sf, "events")
    inner = F.concat(F.lit('{"n":'), F.col("event_id").cast("string"), F.lit(',"Private_Key_Path":"/k","steps":[{"session_token":7,"kind":"'), F.col("event_type"), F.lit('"},[1,2]]}'))
    return e.select("event_id", T.redact_json(F.concat(F.lit('{"MY_PASSWORD":["a","b"],"inner":'), inner, F.lit("}"))).alias("props"))


register("redaction_nested", secrets, """select event_id, '{"MY_PASSWORD":"***REDACTED***","inner":{"n":' || event_id || ',"Private_Key_Path":"***REDACTED***","steps":[{"session_token":"***REDACTED***","kind":"' || event_type || '"},[1,2]]}}' as props from events""")


# -- sources: links and files as the documents table would give them ------------------------------------------------------
def links(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    forms = ["https://www.youtube.com/watch?v=", "https://youtu.be/", "http://m.youtube.com/shorts/", "https://youtube.com/embed/", "ftp://youtube.com/watch?v=", "https://example.org/watch?v=", "https://www.youtube.com/live/"]
    u = F.concat(F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("doc_id") % 7 + 1).cast("int")), F.lit("v"), F.lpad(F.col("doc_id").cast("string"), 10, "0"))
    return d.withColumn("url", u)


def video_links(spark, sf):
    i, e = media.video_link(F.col("url"))
    return links(spark, sf).select("doc_id", i.alias("video_id"), e.alias("error"))


register("video_links", video_links, "select doc_id, case when doc_id % 7 in (4, 5) then null else 'v' || lpad(doc_id::varchar, 10, '0') end as video_id, case doc_id % 7 when 4 then 'UNSUPPORTED_SCHEME' when 5 then 'UNSUPPORTED_HOST' end as error from documents")


def grid(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), (F.col("o_orderkey") % 40 + 0.5).alias("duration_seconds"))
    return media.sampling_grid(d, P).groupBy("job_id").agg(F.count("*").alias("frames"), F.max("timestamp_seconds").alias("last_seconds"))


register("sampling_grid", grid, "select cast(o_orderkey as varchar) as job_id, sum(o_orderkey % 40 + 1)::bigint as frames, max(o_orderkey % 40)::double as last_seconds from orders group by 1")
