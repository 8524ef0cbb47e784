"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidewatch.llm import bpe, collocations, huffman, linequality, neighbours, packing, runs, secrets, simhash, suffixes, toxicity, warc, weakquality
from tidewatch.llm.common import table
from tidewatch.llm.registry import CHECKS, QUERIES, query  # noqa: F401


@query("op9_simhash_near_duplicates")
def op9(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_secret_spans")
def op7(spark, folder):
    return secrets.digested(secrets.scan(table(spark, folder, "documents")))


@query("op4_line_quality")
def op4(spark, folder):
    return linequality.judged(table(spark, folder, "documents"))


@query("op1_toxic_segments")
def op1(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = toxicity.train(docs, table(spark, folder, "labels"), ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"), "passages")


@query("op8_huffman_token_files")
def op8(spark, folder):
    return huffman.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query("op2_block_neighbours", """
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 20 = 0)
select query_id, rank, vec_id, score from (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from pairs)
where rank <= 20""")
def op2(spark, folder):
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query("op10_warc_revisits", """
with p as (select page_id, coalesce(html, '') as h from pages),
o as (select *, max(page_id) over (partition by h) as last from p)
select page_id, cast(strlen(h) as bigint) as payload_bytes, sha1(encode(h)) as payload_digest,
  case when strlen(h) >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
  case when strlen(h) >= 1000 and page_id <> last then last end as refers_to
from o""")
def op10(spark, folder):
    return warc.round_trip(table(spark, folder, "pages"))


@query("op6_bm25_packing")
def op6(spark, folder):
    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_byte_bpe")
def op3(spark, folder):
    return bpe.coded(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_weak_label_quality")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    return weakquality.scored(docs, weakquality.train(docs))


@query("op11_phrase_collocations", r"""
with recursive d as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as words from p),
n as (select lang, cast(sum(len(words)) as bigint) as n from w group by lang),
g as (select lang, m, array_to_string(words[i:i + m - 1], ' ') as phrase
  from (select lang, words, m, unnest(range(1, len(words) - m + 2)) as i from w, unnest(range(1, 6)) as s(m))),
f as (select lang, m, phrase, count(*) as a from g group by lang, m, phrase having count(*) >= 100),
s as (select *, string_split(phrase, ' ') as x from f),
longer as (select lang, m, a, unnest([array_to_string(x[1:m - 1], ' '), array_to_string(x[2:m], ' ')]) as phrase from s where m > 2),
c as (select * from s where m > 1 and not exists (
  select 1 from longer where longer.lang = s.lang and longer.phrase = s.phrase and longer.a = s.a)),
cut as (select c.*, k, array_to_string(x[1:k], ' ') as lp, array_to_string(x[k + 1:m], ' ') as rp from c, unnest(range(1, 5)) as u(k) where k < m),
sc as (select cut.*, l.a as l, r.a as r, n.n, (1000::hugeint * cut.a * n.n) // (l.a::hugeint * r.a) as score
  from cut join f l on l.lang = cut.lang and l.phrase = lp join f r on r.lang = cut.lang and r.phrase = rp join n on n.lang = cut.lang),
worst as (select * from sc qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from worst),
step as (select e.lang, e.phrase, x.phrase as next, x.x[5] as word
  from s e join s v on v.lang = e.lang and v.m = 4 and v.a = e.a and v.phrase = array_to_string(e.x[2:5], ' ')
  join s x on x.lang = e.lang and x.m = 5 and x.a = e.a and array_to_string(x.x[1:4], ' ') = v.phrase where e.m = 5),
path as (
  select lang, phrase as head, phrase as last, phrase as path, 1 as size from s where m = 5 and not exists (select 1 from step where step.lang = s.lang and next = s.phrase)
  union all select path.lang, head, next, path || ' ' || word, size + 1 from path join step on step.lang = path.lang and step.phrase = path.last),
whole as (select * from path qualify row_number() over (partition by lang, head order by size desc) = 1)
select ranked.lang, rank, phrase, a, l, r, n, cast(score as bigint) as score, whole.path
from ranked left join whole on whole.lang = ranked.lang and whole.head = ranked.phrase where rank <= 2000""")
def op11(spark, folder):
    return collocations.Collocations(table(spark, folder, "documents")).best()


@query("op12_suffix_array_dedup")
def op12(spark, folder):
    kept = suffixes.without_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_periodic_runs")
def op13(spark, folder):
    found = runs.runs(table(spark, folder, "documents"), planted=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))
