"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm import fingerprints, hard_negatives, jaccard, language, merkle, mixing, neighbours, packing, quality, repeats, secrets, url_filter, warc
from contactloom.llm.common import table
from contactloom.llm.settings import MIX_TARGETS, URL_RULES, byte_bpe, held_out, labelled_domains

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


OP3_SQL = f"""
with rules(rhost, rpath, rverdict) as (values {", ".join(str(r) for r in URL_RULES)}),
cut as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
), parsed as (
  select page_id,
    translate(coalesce(regexp_extract(rest, '(?s)^([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(rest, '(?s)^([^/?#]*)([^?#]*)', 2), '') as path
  from cut
), fits as (
  select distinct host, path, rhost || rpath as rule, rverdict,
    row_number() over (partition by host, path order by length(rhost || rpath) desc, length(rhost) desc) as n
  from (select distinct host, path from parsed) join rules
    on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select p.page_id, p.host, p.path, f.rule, coalesce(f.rverdict, 'allow') as verdict
from parsed p left join (select * from fits where n = 1) f on p.host = f.host and p.path = f.path
"""


@query("op3_url_filters", OP3_SQL)
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.match_rules(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op2_secret_scans")
def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language.fit(docs.where(~held_out()))
    return language.predict(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op5_neighbours")
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, labelled_domains(spark, sf_dir), MIX_TARGETS, carry=["doc_id"])


OP7_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by payload_digest)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when f.first <> d.page_id then 'revisit' else 'response' end as record_type,
  case when f.first <> d.page_id then f.first end as refers_to
from d left join f on d.payload_digest = f.payload_digest and d.payload_bytes >= 100
"""


@query("op7_warc", OP7_SQL)
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as words from documents
), s as (
  select doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
    else list_distinct(list_transform(generate_series(1, len(words) - 3), lambda i: array_to_string(words[i:i+3], ' '))) end) as gram from w
), n as (
  select w.doc_id, count(s.gram) as n_shingles from w left join s on w.doc_id = s.doc_id group by w.doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2
), link as (
  select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.o >= 85 * (x.n_shingles + y.n_shingles - p.o)
), reach(a, b) as (
  select doc_id, doc_id from n union select r.a, l.b from reach r join link l on r.b = l.a
)
select n.doc_id, n.n_shingles, min(r.b) as component_id from n join reach r on n.doc_id = r.a group by 1, 2
"""


@query("op8_near_duplicates", OP8_SQL)
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_fingerprints")
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("marks")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, ranks = byte_bpe()
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary, ranks=ranks)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


OP11_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
OP11_SQL = """
with recursive leaves as (
  select row_number() over () as rid, doc_id, source, {leaf} as leaf, text as t,
    xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda d, k: xor(d >> 1, (d & 1) * 3988292384))), 4294967295) % 2 = 0 as tampers, lang, n_chars
  from documents
), marked as (
  select rid, doc_id, source, leaf, coalesce(tampers, false) as tampers, {tampered} as tampered from (select *, replace(t, chr(10), '') as text from leaves)
), l as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as n from marked
), up(source, level, idx, n, h) as (
  select source, 0, idx, n, leaf from l
  union all
  select source, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' order by idx)) from up where n > 1 group by source, level, idx // 3, n
), sib as (
  select a.source, a.level, a.idx, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx < a.idx), '') as lft,
    coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx > a.idx), '') as rgt
  from up a join up b on a.source is not distinct from b.source and a.level = b.level and a.idx // 3 = b.idx // 3 where a.n > 1 group by 1, 2, 3
), fold(rid, source, level, idx, n, cur, proof) as (
  select rid, source, 0, idx, n, case when tampers then tampered else leaf end, '' from l
  union all
  select f.rid, f.source, f.level + 1, f.idx // 3, (f.n + 2) // 3, sha256(lft || cur || rgt), proof || lft || rgt
  from fold f join sib s on f.source is not distinct from s.source and f.level = s.level and f.idx = s.idx where f.n > 1
), sub as (
  select source, h, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as n from up where n = 1
), up2(level, idx, n, h) as (
  select 0, idx, n, h from sub
  union all
  select level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' order by idx)) from up2 where n > 1 group by level, idx // 3, n
), sib2 as (
  select a.level, a.idx, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx < a.idx), '') as lft,
    coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx > a.idx), '') as rgt
  from up2 a join up2 b on a.level = b.level and a.idx // 3 = b.idx // 3 where a.n > 1 group by 1, 2
), fold2(rid, level, idx, n, cur, proof) as (
  select f.rid, 0, s.idx, s.n, f.cur, f.proof from fold f join sub s on f.source is not distinct from s.source where f.n = 1
  union all
  select f.rid, f.level + 1, f.idx // 3, (f.n + 2) // 3, sha256(lft || cur || rgt), proof || lft || rgt
  from fold2 f join sib2 s on f.level = s.level and f.idx = s.idx where f.n > 1
)
select l.doc_id, l.leaf, s.h as subroot, r.h as root, sha256(f.proof) as proof_sha256, f.cur as folded_root, f.cur = r.h as verified
from l join fold2 f on l.rid = f.rid and f.n = 1 join sub s on l.source is not distinct from s.source join (select h from up2 where n = 1) r on true
"""


def _leaf_sql(fields: list[str]) -> str:
    parts = [f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in fields]
    return f"sha256({' || '.join(parts)})"


@query("op11_merkle_manifest", OP11_SQL.format(leaf=_leaf_sql(OP11_FIELDS), tampered=_leaf_sql(OP11_FIELDS)))
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    without_breaks = [F.translate(F.col(c), "\n", "") if c == "text" else F.col(c) for c in OP11_FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf_of(*without_breaks))
    proven = merkle.manifest(docs, OP11_FIELDS, "source", "doc_id", 3, {"tampered": tampered})
    again = proven.withColumn("folded", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return again.select(
        "doc_id",
        merkle.as_text(F.col("leaf")).alias("leaf"),
        merkle.as_text(F.col("subroot")).alias("subroot"),
        merkle.as_text(F.col("root")).alias("root"),
        F.sha2(merkle.proof_of(F.col("path")), 256).alias("proof_sha256"),
        merkle.as_text(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


OP12_SQL = """
with r as (
  select distinct vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.id as anchor, b.id as other, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from r a join r b on a.id % 100 = 0 and a is distinct from b
), p as (
  select anchor, other, score from s where same qualify row_number() over (partition by anchor order by score desc, other) <= 5
)
select p.anchor as anchor_id, p.other as positive_id,
  row_number() over (partition by p.anchor, p.other order by n.score desc, n.other)::int as rank, n.other as negative_id, p.score as positive_score, n.score as negative_score
from p join s n on n.anchor = p.anchor and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify row_number() over (partition by p.anchor, p.other order by n.score desc, n.other) <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


@query("op13_quality_rules")
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    judged = quality.judge(docs, quality.learn(docs, trusted))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
