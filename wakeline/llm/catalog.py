"""One query for each text operator, over the whole documents table."""

from __future__ import annotations

from wakeline.llm import (
    byte_bpe, clustering, exact_dedup, hard_negatives, licenses, line_dedup, lm_scoring, minhash_bayes, packing, quality_rules,
    resampling, similarity_join, toxicity,
)
from wakeline.llm.common import documents, table
from wakeline.llm.registry import QUERIES, SQL, query

NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


@query("op9_exact_dedup", f"""
with n as (select doc_id, sha256({NORM}) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, text_sha256
from n window w as (partition by text_sha256)
""")
def op9_exact_dedup(spark, folder):
    return exact_dedup.exact_groups(documents(spark, folder))


@query("op1_quality_rules", r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
g as (select r, unnest(range(1, greatest(len(words) - 1, 1))) as p, words from d),
t as (select r, p, count(*) over (partition by r, words[p], words[p + 1], words[p + 2]) as n from g),
c as (select r, count(distinct p + k) as n_repeat_words from t, unnest([0, 1, 2]) as o(k) where n > 1 group by r),
m as (
  select doc_id, len(words) as n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         len(lines) - len(list_distinct(lines)) as n_dup_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, len(lines) as n_lines,
         len(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals
  from d left join c using (r)),
b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    cast((n_words < 50) as bigint) + 2 * cast((100 * n_repeat_words > 50 * n_words) as bigint)
    + 4 * cast((10 * n_symbols > n_words) as bigint) + 8 * cast((100 * n_dup_lines > 30 * n_lines) as bigint)
    + 16 * cast((word_chars < 2 * n_words or word_chars > 20 * n_words) as bigint)
    + 32 * cast((2 * n_capitals > word_chars) as bigint) as failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, failed,
       base_failed, failed = 0 as kept
from b
""")
def op1_quality_rules(spark, folder):
    return quality_rules.quality_verdicts(documents(spark, folder))


@query("op2_license_scan")
def op2_license_scan(spark, folder):
    return licenses.license_scan(documents(spark, folder))


@query("op6_byte_bpe")
def op6_byte_bpe(spark, folder):
    return byte_bpe.round_trip(documents(spark, folder))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark, folder):
    return packing.pack_documents(documents(spark, folder))


@query("op3_line_dedup", r"""
with l as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line,
         unnest(range(0, len(string_split(text, chr(10))))) as pos
  from documents where text is not null),
c as (
  select *, row_number() over (partition by doc_id order by pos) as r
  from (select *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n from l)
  where n > 0),
s as (
  select doc_id, pos as s0, lead(pos) over w as s1, lead(pos, 2) over w as s2, line as l0, lead(line) over w as l1,
         lead(line, 2) over w as l2, n + coalesce(lead(n) over w, 0) as two, n
  from c window w as (partition by doc_id order by r)),
k as (
  select *, case when n >= 50 then 1 when two >= 50 then 2 else 3 end as size from s),
f as (
  select *, row_number() over (partition by size, l0, case when size > 1 then l1 end, case when size > 2 then l2 end
                               order by doc_id, s0) as nth
  from k where (size < 2 or l1 is not null) and (size < 3 or l2 is not null)),
dead as (
  select distinct doc_id, unnest([s0, case when size > 1 then s1 end, case when size > 2 then s2 end]) as pos
  from f where nth > 1)
select d.doc_id, coalesce(t.text, case when d.text is not null then '' end) as text,
       coalesce(len(string_split(d.text, chr(10))), 0) as n_lines,
       (select count(*) from dead x where x.doc_id = d.doc_id and x.pos is not null) as n_deleted
from documents d left join (
  select l.doc_id, string_agg(line, chr(10) order by pos) as text
  from l anti join (select * from dead where pos is not null) using (doc_id, pos) group by l.doc_id) t using (doc_id)
""")
def op3_line_dedup(spark, folder):
    return line_dedup.delete_repeated_runs(documents(spark, folder))


@query("op7_toxicity")
def op7_toxicity(spark, folder):
    return toxicity.toxicity_scores(documents(spark, folder), table(spark, folder, "labels"))


@query("op10_quality_classifier")
def op10_quality_classifier(spark, folder):
    return resampling.resample(documents(spark, folder), table(spark, folder, "labels"))


@query("op5_ngram_jaccard_join", r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
g as (
  select distinct doc_id, array_to_string(words[p : p + 3], ' ') as gram
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as p from w where len(words) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
l as (
  select a.doc_id as u, b.doc_id as v from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  where 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
r as (select doc_id as a, doc_id as b from w union select r.a, l.v from r join l on l.u = r.b)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from w left join n using (doc_id) join (select a, min(b) as component_id from r group by a) c on c.a = w.doc_id
""")
def op5_ngram_jaccard_join(spark, folder):
    return similarity_join.similar_components(documents(spark, folder))


@query("op8_lm_scoring")
def op8_lm_scoring(spark, folder):
    return lm_scoring.score_documents(documents(spark, folder))


WHOLE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
INTS = "list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint))"


@query("op11_hard_negatives", f"""
with r as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {INTS} as v
  from embeddings where label is not null and {WHOLE}),
s as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label,
         cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
  from r a join r b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (
  select *, row_number() over (partition by anchor_id order by score desc, vec_id) as nth
  from s where label = anchor_label),
n as (
  select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as nth
  from p join s on p.nth <= 5 and s.anchor_id = p.anchor_id and s.label <> s.anchor_label
    and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, cast(nth as integer) as rank, negative_id, positive_score, negative_score from n where nth <= 3
""")
def op11_hard_negatives(spark, folder):
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"))


def _lloyd_sql(rounds: int = clustering.ROUNDS, k: int = clustering.CLUSTERS, size: int = clustering.SIZE) -> str:
    """The rounds written out, one after the other."""
    squared = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    steps = [f"""
with x as materialized (
  select row_number() over () as r, vec_id, {INTS} as v from embeddings where len(embedding) = {size} and {WHOLE}),
c0 as materialized (
  select cast(row_number() over (order by h, v) - 1 as integer) as cluster, v
  from (select sha256('2:' || coalesce(cast(vec_id as varchar), 'null')) as h, v from x order by h, v limit {k}))"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} as materialized (
  select r, arg_min(cluster, (d, cluster)) as cluster, min(d) as distance
  from (select x.r, c.cluster, cast({squared} as bigint) as d from x, c{n} c) group by r)""")
        if n < rounds:
            steps.append(f"""t{n} as (
  select cluster, place, sum(v[place]) as s, count(*) as n
  from a{n} join x using (r), unnest(range(1, {size + 1})) as u(place) group by cluster, place),
m{n} as (
  select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by place) as v from t{n} group by cluster),
c{n + 1} as materialized (select c.cluster, coalesce(m.v, c.v) as v from c{n} c left join m{n} m using (cluster))""")
    return ",\n".join(steps) + f"""
select x.vec_id, a.cluster, a.distance, cast(sum(a.distance) over (partition by a.cluster) as bigint) as cluster_inertia,
       cast(sum(a.distance) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join x using (r) join c{rounds} c using (cluster)
"""


@query("op12_centroid_clustering", _lloyd_sql())
def op12_centroid_clustering(spark, folder):
    return clustering.cluster_report(table(spark, folder, "embeddings"))


@query("op13_minhash_near_dedup", r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
g as (
  select distinct doc_id, array_to_string(words[p : p + 2], ' ') as gram
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) as p from w where len(words) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
l as (
  select a.doc_id as u, b.doc_id as v from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  where 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
r as (select doc_id as a, doc_id as b from w union select r.a, l.v from r join l on l.u = r.b)
select w.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, w.doc_id = c.component_id as kept
from w left join n using (doc_id) join (select a, min(b) as component_id from r group by a) c on c.a = w.doc_id
""")
def op13_minhash_near_dedup(spark, folder):
    return minhash_bayes.near_duplicates(documents(spark, folder))


__all__ = ["QUERIES", "SQL"]
