"""The checked queries of the training-data operators, each beside its SQL form where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabscout.llm import brown, codes, merkle, packing, pieces, pii, polytope, rules, search, simhash, suffixes, warc, weaklabels
from tabscout.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WORD_TOKENS = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_warc", """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, sha1(html) as h, max(page_id) over (partition by html) as top from p),
b as (select *, list_transform(range(40), lambda k: ('0x' || h[k + 1])::int) as x from d)
select page_id, n::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    (list_reduce(list_transform(range(5), lambda j: ((x[((5 * k + j) // 4 + 1)::bigint] >> (3 - (5 * k + j) % 4)) & 1)::int),
      lambda a, c: 2 * a + c) + 1)::bigint]), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to
from b""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans_of_documents(table(spark, sf_dir, "documents"))


@query("op3_rules")
def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_report(table(spark, sf_dir, "documents"))


@query("op4_suffixes")
def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_report(table(spark, sf_dir, "documents"))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENS)


@query("op6_weaklabels")
def op6_weaklabels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabels.quality_scores(table(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query("op8_merkle")
def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_report(table(spark, sf_dir, "documents"))


@query("op9_brown")
def op9_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(table(spark, sf_dir, "documents"))


@query("op10_pieces")
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


@query("op11_polytope", """
with recursive v as (select row_number() over () as r, vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.r as x, b.r as y from v a join v b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select r, r as c from v union select reach.r, links.y from reach join links on reach.c = links.x),
parts as (select reach.r, min(v.vec_id) as component_id from reach join v on reach.c = v.r group by reach.r),
counts as (select x as r, count(*)::bigint as n_links from links group by x),
linked as (select v.vec_id, coalesce(n_links, 0)::bigint as n_links, component_id from v join parts using (r) left join counts using (r)),
every as (select * from linked union all select vec_id, 0::bigint, vec_id from embeddings e where not coalesce(
  label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0, false))
select *, vec_id is not distinct from component_id as kept from every""")
def op11_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.near_vectors(table(spark, sf_dir, "embeddings"))


def codes_sql() -> str:
    """The rounds one after another: a{k} assigns parts to the entries c{k}, whose means are c{k + 1}."""
    sql = """
with kept as (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, len(embedding)::bigint // 4 as d,
    list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
  from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select r, p, d, v[p * d + 1 : (p + 1) * d] as x from kept, range(4) t(p)),
c0 as (select p, r - 1 as e, x as c from parts where r <= 256),"""
    for k in range(5):
        sql += f"""
a{k} as materialized (select r, p, any_value(x) as x, any_value(d) as d, min(far) as far, min(e) filter (far = least) as e from (
    select *, min(far) over (partition by r, p) as least from (
      select r, parts.p, x, d, e, list_sum(list_transform(range(1, d + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint as far
      from parts join c{k} on parts.p = c{k}.p)) group by r, p),"""
        if k < 4:
            sql += f"""
m{k} as (select p, e, list(mean order by i) as c from (
    select p, e, i, floor(sum(x[i])::double / count(*))::bigint as mean from (select *, unnest(range(1, d + 1)) as i from a{k}) group by p, e, i) group by p, e),
c{k + 1} as materialized (select c{k}.p, c{k}.e, coalesce(m{k}.c, c{k}.c) as c from c{k} left join m{k} on c{k}.p = m{k}.p and c{k}.e = m{k}.e),"""
    return sql + """
book as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from c4),
coded as (select r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' order by p) as code, sum(far)::bigint as error from a4 group by r)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from kept join coded using (r), book"""


@query("op12_codes", codes_sql())
def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


@query("op13_nra", r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
n as (select r, doc_id, t, len(t)::bigint as n from d where len(t) > 0),
whole as (select count(*)::bigint as docs, sum(n)::bigint as tokens from n),
c as (select r, term, count(*)::bigint as tf from (select r, unnest(t) as term from n) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from c, whole group by term, docs),
q as (select distinct item, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as item, * from benchmark)),
s as (select item, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // tokens))))::bigint as score
  from q join c using (term) join w using (term) join n using (r), whole group by all),
k as (select item_id, row_number() over (partition by item order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 50""")
def op13_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
