"""The registered queries of this subpackage, and SQL for those that SQL can express."""

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, decontam, langid, neardup, ppm, quality, topk, toxicity, urlfilter, warc

#: The rules of the url query, as (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark, sf_dir):
    """Every page as a WARC record, written and read back."""
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op2_quality(spark, sf_dir):
    """Every document's expected grade and tail probabilities."""
    return quality.score(read(spark, sf_dir, "documents"), quality.graded(read(spark, sf_dir, "labels")))


def op3_toxicity(spark, sf_dir):
    """Every document's toxicity by its nearest labelled examples."""
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_url_filters(spark, sf_dir):
    """The verdict on every page's url."""
    return urlfilter.judge(read(spark, sf_dir, "pages"), urlfilter.rules(spark, URL_RULES))


def op5_byte_bpe(spark, sf_dir):
    """Every document encoded, and digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(read(spark, sf_dir, "documents"), path), path)


def op6_decontamination(spark, sf_dir):
    """Every document and benchmark item that it holds."""
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_language_model(spark, sf_dir):
    """Every document's word baseline and byte-context score, learnt from six sevenths of them."""
    return ppm.score(read(spark, sf_dir, "documents"))


def op8_ngram_join(spark, sf_dir):
    """Every document's number of shingles and component of linked documents."""
    return neardup.join(read(spark, sf_dir, "documents"))


def op9_top_products(spark, sf_dir):
    """Every fiftieth vector's five largest integer inner products."""
    return topk.top(read(spark, sf_dir, "embeddings"))


def op10_language(spark, sf_dir):
    """Every document's language by rank-order profiles."""
    return langid.predict(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_quality, op3_toxicity, op4_url_filters, op5_byte_bpe, op6_decontamination, op7_language_model, op8_ngram_join, op9_top_products, op10_language)}

ORACLES = {
    "op1_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select sha1(html) as sha, max(page_id) as keeper from p group by all),
d as (select p.page_id, octet_length(encode(p.html)) as payload_bytes, sha1(p.html) as sha, keeper from p join g on g.sha = sha1(p.html))
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + cast((cast('0x' || substr(sha, cast((i // 4) * 5 + 1 as int), 5) as int) // cast(pow(32, 3 - i % 4) as int)) % 32 as int), 1)), '') as payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end as record_type,
  case when page_id = keeper then null else keeper end as refers_to, cast(null as varchar) as error
from d""",
    "op4_url_filters": """
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
s as (select page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
r(verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m as (select s.page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
  from s join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all)
select s.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from s left join m using (page_id)""",
    "op9_top_products": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 5""",
}
