"""The queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, divergence, exact_dedup, line_quality, merkle, near_dedup, packing, pseudo_likelihood, rp_forest, secrets, sharding, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest="text_sha256")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = line_quality.score_documents(docs, line_quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", line_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= line_quality.THRESHOLD).cast("int").alias("predicted"))


def op5_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.block_list(spark)).drop("maybe_listed")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))[0].drop("row")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 40)


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pseudo_likelihood.score_documents(docs, pseudo_likelihood.fit(docs))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(7)) == 0)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", line_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_line_quality": op4_line_quality,
    "op5_rp_forest": op5_rp_forest,
    "op6_bpe": op6_bpe,
    "op7_url_filter": op7_url_filter,
    "op8_near_dedup": op8_near_dedup,
    "op9_sharding": op9_sharding,
    "op10_pseudo_likelihood": op10_pseudo_likelihood,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}

OP2_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""

_URL = """
u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
c as (select *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/)$', '') as canonical from p)
"""


def op7_sql() -> str:
    rules = " union all ".join(f"select '{v}' as verdict, '{h}' as h, '{p}' as p" for v, h, p in url_filter.RULES)
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return f"""
with r as ({rules}), {_URL},
fit as (select page_id, h || p as rule, r.verdict, row_number() over (partition by page_id order by length(h || p) desc) as k
        from c join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)),
l as (select canonical
      from (select site || '/' || language || '/' || n as canonical
            from (select unnest([{listed(url_filter.SITES)}]) as site), (select unnest([{listed(url_filter.LANGUAGES)}]) as language), range(1, {url_filter.PAGES + 1}) t(n))
      where substr(md5(canonical), 1, 1) in ({listed(url_filter.MARKS)}))
select c.page_id, c.host, c.path, fit.rule,
       coalesce(fit.verdict, case when l.canonical is not null then 'block' else 'allow' end) as verdict,
       l.canonical is not null as listed
from c left join fit on fit.page_id = c.page_id and fit.k = 1 left join l on l.canonical = c.canonical
"""


def _crc_table() -> str:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(str(c))
    return ", ".join(out)


def op9_sql(shards: int = 40) -> str:
    """For equal shards, five to a rack and two racks to a region. At each level the child with the least draw is the one with the greatest number, as all weigh alike; the shard that is added weighs a tenth of a region."""
    number = lambda path: f"((('0x' || substr(md5(key || '|' || {path}), 1, 13))::bigint + 0.5) / 4503599627370496.0)"
    most = lambda n, path: f"list_position(list_transform(range({n}), lambda i: {number(path)}), list_max(list_transform(range({n}), lambda i: {number(path)}))) - 1"
    return f"""
with k as (select doc_id, coalesce(cast(doc_id as varchar), '') as key, list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda c: strpos('123456789ABCDEF', c)) as x from documents),
b as (select doc_id, key, list_transform(range(1, len(x) // 2 + 1), lambda i: 16 * x[2 * i - 1] + x[2 * i]) as bytes from k),
c as (select doc_id, key, len(bytes) as n, xor(4294967295, coalesce(list_reduce(bytes, lambda x, y: xor(x >> 8, [{_crc_table()}][1 + xor(x & 255, y)]), 4294967295::bigint), 4294967295)) as text_crc32 from b),
g as (select *, {most(shards // 10, "'g' || i")} as g from c),
r as (select *, {most(2, "g || '|r' || i")} as r from g),
s as (select *, {most(5, "g || '|' || r || '|s' || i")} as s from r)
select doc_id, cast(n + 16 as bigint) as size, text_crc32, 'key' as law, cast(10 * g + 5 * r + s as int) as shard,
       row_number() over (partition by 10 * g + 5 * r + s order by md5(key || '|' || text_crc32)) - 1 as slot,
       cast(case when -ln({number(f"'g{shards // 10}'")}) < -ln({number("'g' || g")}) / 10 then {shards} else 10 * g + 5 * r + s end as int) as grown_shard
from s
"""


def op11_sql() -> str:
    """Trees level by level, then every leaf's way up, one level a turn."""
    field = lambda x: f"case when {x} is null then '-' else strlen({x}::varchar) || ':' || {x} end"
    leaf = lambda n: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", n, "text"])) + ")"
    digits = "list_transform(string_split(doc_id::varchar, ''), lambda c: 48 + c::int)"  # ids of this table are not negative
    crc = f"xor(4294967295, list_reduce({digits}, lambda x, y: xor(x >> 8, [{_crc_table()}][1 + xor(x & 255, y)]), 4294967295::bigint))"
    parent = "sha256(string_agg(h, '' order by i))"
    return f"""
with recursive d as (select doc_id, coalesce('v' || lang, 'n') as g, {leaf("n_chars")} as h, case when {crc} % 7 = 0 and n_chars is not null then {leaf("(n_chars + 1)")} end as other from documents),
leaves as materialized (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i, count(*) over (partition by g) as n from d),
t as (select g, 0 as l, i, n, h from leaves union all select g, l + 1, i // 2, (n + 1) // 2, {parent} from t where n > 1 group by g, l, i // 2, (n + 1) // 2),
tree as materialized (select * from t),
subs as materialized (select g, h, row_number() over (order by g) - 1 as i, count(*) over () as n from tree where n = 1),
s as (select 0 as l, i, n, h from subs union all select l + 1, i // 2, (n + 1) // 2, {parent} from s where n > 1 group by l, i // 2, (n + 1) // 2),
top as materialized (select * from s),
steps as materialized (
  select doc_id, leaves.g, leaves.i as place, tree.l, b.h as beside, (leaves.i >> tree.l) % 2 = 1 as lefts
  from leaves join tree on tree.g = leaves.g and tree.n > 1 and tree.i = leaves.i >> tree.l left join tree b on b.g = tree.g and b.l = tree.l and b.i = xor(tree.i, 1)
  union all select doc_id, leaves.g, leaves.i, 100 + top.l, b.h, (subs.i >> top.l) % 2 = 1
  from leaves join subs using (g) join top on top.n > 1 and top.i = subs.i >> top.l left join top b on b.l = top.l and b.i = xor(top.i, 1)),
ways as materialized (select g, place, list({{'h': beside, 'left': lefts}} order by l) as way, string_agg(beside, '' order by l) as proof from steps group by all),
f as (select leaves.g, leaves.i, 1 as k, coalesce(other, leaves.h) as h, way from leaves left join ways on ways.g = leaves.g and ways.place = leaves.i
  union all select g, i, k + 1, sha256(case when way[k].h is null then h when way[k].left then way[k].h || h else h || way[k].h end), way from f where k <= len(way)),
ends as (select g, i, h from f where k = coalesce(len(way), 0) + 1)
select doc_id, leaves.h as leaf, subs.h as subroot, root.h as root, sha256(coalesce(proof, '')) as proof_sha256, ends.h as folded_root, ends.h = root.h as verified
from leaves join subs on subs.g = leaves.g join (select h from top where n = 1) root on true join ends on ends.g = leaves.g and ends.i = leaves.i left join ways on ways.g = leaves.g and ways.place = leaves.i
"""


OP13_SQL = """
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as (select lang, term from t group by all having count(distinct row) >= 30),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by all),
v as (select lang, count(*) as v from k group by all),
groups as (select distinct lang, source from d),
every as (select g.lang, g.source, k.term, coalesce(n, 0) as n from groups g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p from every join v using (lang)),
l as (select lang, term, sum(n) as n from every group by all),
q as (select lang, term, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang) + 5 * v) as q from l join v using (lang)),
pairs as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0)::bigint as value
          from groups g join groups h on g.lang = h.lang and g.source <> h.source
          left join (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term group by all) s on s.lang = g.lang and s.source = g.source and s.item = h.source),
terms as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p join q using (lang, term) where n > 0 and p > q)
select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pairs union all select * from terms) qualify part = 'pair' or rank <= 50
"""


ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op7_url_filter": op7_sql(), "op9_sharding": op9_sql(), "op11_merkle_manifest": op11_sql(), "op13_source_divergence": OP13_SQL}
