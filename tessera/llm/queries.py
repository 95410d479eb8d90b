"""The queries of this package, and their SQL where SQL can say them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import session
from tessera.llm import common, fim, ordinal, packing, parity_join, pii, postings, rabitq, raking, runs, sstable, transcript, url_filter, vptree

URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: URLs that carry a tracking parameter make the list: every page at such an address is blocked.
#: Surrogates follow from this key; a deployment sets its own and keeps it secret.
PII_KEY = os.environ.get("TESSERA_PII_KEY", "surrogate-key-1")
TRACKED = r"[?&](utm_[a-z]+|ref)="


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the rules, else by the list of tracked addresses."""
    pages = _t(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.col("url").rlike(TRACKED)).select("url")
    return url_filter.judge(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "listed", "verdict")


OP1_SQL = r"""
with p as (
  select page_id, url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
c as (select *, case when contains(url, '://') then host || regexp_replace(path, '/+$', '') end as canon from p),
l as (select distinct canon from c where regexp_matches(url, '[?&](utm_[a-z]+|ref)=') and canon is not null),
r(what, rhost, rpath) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
j as (
  select c.page_id, c.host, c.path, l.canon is not null as listed,
         (select arg_max(struct_pack(rule := rhost || rpath, what := what), length(rhost || rpath) * 1000 + length(rhost)) from r
          where (c.host = rhost or ends_with(c.host, '.' || rhost)) and starts_with(c.path, rpath)) as best
  from c left join l using (canon))
select page_id, host, path, best.rule as rule, listed,
       coalesce(best.what, case when listed then 'block' else 'allow' end) as verdict
from j
"""


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as sorted-string-table shards and read back from them."""
    import public_tokenizers

    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = sstable.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return sstable.read_back(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data replaced."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, PII_KEY, count="n_entities")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into bins of 2048 words, sources and near copies (classes of op6_parity_join) apart."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # rows by number where ids repeat or are null
    unclear = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null")
    if unclear.isEmpty():
        rows = docs.withColumn("row", F.col("doc_id"))
    else:
        rows = common.cut(docs.withColumn("row", F.monotonically_increasing_id()), "pack-rows")
    items = rows.select("doc_id", "row", "source").join(parity_join.classes(rows, id="row").select("row", "n_words", "component_id"), "row")
    return packing.pack(items, "doc_id", F.col("n_words"), F.col("source"), F.col("component_id"))


def op5_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every 50th vector among all vectors, searched exactly (factor 1)."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.search(rows, rows.where("vec_id % 50 = 0"), 5)


OP5_SQL = """
with v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))) as score
  from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document under links of 5-word shingle Jaccard >= 0.8."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return parity_join.classes(docs).select("doc_id", "n_shingles", "component_id")


def op7_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9."""
    return rabitq.near_duplicates(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP7_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
  where list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.9),
r(id, hit) as (select a, a from l union select r.id, l.b from r join l on r.hit = l.a),
c as (select id, min(hit) as component_id from r group by id),
m as (select a, count(*) as n_links from l group by a)
select e.vec_id, coalesce(m.n_links, 0)::bigint as n_links, coalesce(c.component_id, e.vec_id) as component_id, coalesce(c.component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join m on e.vec_id = m.a left join c on e.vec_id = c.id
"""


def graded(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", ordinal.severity_of(F.col("toxic"), F.col("quality")).alias("grade"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, by a model fitted on labelled rows."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.fit(docs, graded(_t(spark, sf_dir, "labels")), label="grade")
    return ordinal.grade(docs, model).select("doc_id", "severity", "grade", "rejected")


def op9_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a plain transcript, parsed back into turns in canonical form."""
    turns = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", "role", "text")
    lines = transcript.plain_lines(turns)
    model = transcript.fit(lines.withColumn("symbol", transcript.symbol(F.col("text"))), turns)
    found = transcript.parse(lines, model, "id", "line", "text", chunk=256 << 32)
    return found.select(F.col("id").alias("conv_id"), "turn", "role", transcript.render(F.col("role"), F.col("text")).alias("rendered"))


#: Targets: languages by share, sources and topics flattened.
MARGINS = {"source": 0.7, "lang": {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}, "topic": 0.8}
FRACTION = 0.85


def mix(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    column = {"source": F.col("source"), "lang": F.col("lang"), "topic": raking.topic(text)}
    return raking.rake(docs, {k: (column[k], t) for k, t in MARGINS.items()}, raking.tokens(text), F.col("doc_id"), FRACTION)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its raked factor, its probability and whether it is kept."""
    out = mix(_t(spark, sf_dir, "documents"))
    return out.select("doc_id", F.round("rake_factor", 8).alias("factor"), F.round("rake_p", 8).alias("p"), F.round("rake_weight", 8).alias("weight"), F.col("rake_kept").alias("kept"))


def _op10_sql() -> str:
    """The sweeps written out: each step is one window over the cells."""
    dims = list(MARGINS)
    sql = [r"""d as (
  select doc_id, coalesce(source, chr(1)) as source, coalesce(lang, chr(1)) as lang,
    case when contains(t, 'License') or contains(t, 'Copyright') or contains(t, 'rights reserved') then 'legal'
         when contains(t, '!!') or contains(t, '***') or contains(t, '%%%') then 'noise'
         when contains(t, ' | ') then 'table' when contains(t, '@') then 'contact' when length(t) < 600 then 'note' else 'prose' end as topic,
    len(regexp_extract_all(t, '[^ 	-
]+')) as t
  from (select doc_id, source, lang, coalesce(text, '') as t from documents)),
c as (select source, lang, topic, sum(t)::double as t from d group by all having sum(t) > 0)"""]
    for k in dims:
        target = MARGINS[k]
        share = "sum(t) / (select sum(t) from c)"
        raw = f"power({share}, {target})" if isinstance(target, float) else f"case {k} " + " ".join(f"when '{v}' then {x}" for v, x in target.items()) + f" else {share} end"
        sql.append(f"t_{k} as (select {k}, s / (sum(s) over ()) * (select sum(t) from c) as want_{k} from (select {k}, {raw} as s from c group by {k}))")
    sql.append(f"w0 as materialized (select c.*, {', '.join(f'want_{k}' for k in dims)}, 1.0::double as w from c " + " ".join(f"join t_{k} using ({k})" for k in dims) + ")")
    n = 0
    for _ in range(raking.SWEEPS):
        for k in dims:
            n += 1
            sql.append(f"w{n} as materialized (select * exclude (w), w * want_{k} / sum(w * t) over (partition by {k}) as w from w{n - 1})")
    sql.append(f"""o as (select *, row_number() over (order by w desc, source, lang, topic) as k, {FRACTION} * sum(t) over () as goal,
  coalesce(sum(t) over (order by w desc, source, lang, topic rows between unbounded preceding and 1 preceding), 0) as before,
  sum(w * t) over (order by w desc, source, lang, topic rows between current row and unbounded following) as rest from w{n}),
q as (select arg_min((goal - before) / rest, k) as c from o where (goal - before) / rest * w <= 1),
p as (select source, lang, topic, w, least(1.0, q.c * w) as p from o, q)
select doc_id, round(coalesce(w, 1.0), 8) as factor, round(coalesce(p, {FRACTION}), 8) as p, round(coalesce(w, 1.0) / coalesce(p, {FRACTION}), 8) as weight,
  (('0x' || substr(md5('7:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / power(2, 52)) < coalesce(p, {FRACTION}) as kept
from d left join p using (source, lang, topic)""")
    return "with " + ",\n".join(sql)


OP10_SQL = _op10_sql()


def with_period(id: Column, text: Column) -> Column:
    """The text; of every tenth id by crc32 its words, from word n - or the crc32 picks where - on repeating with a period."""
    h = F.crc32(F.coalesce(id.cast("string"), F.lit("null")))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeat(ws: Column) -> Column:
        n, g = F.size(ws), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")

    # an array of one element, so that the words are cut once
    some = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeat(ws)).otherwise(F.lit("")))[0]
    return F.when(h % 10 == 0, some).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which are made to end in one."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", with_period(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.find(docs).select("doc_id", "found.*")
    # the greatest length / period: products compared exactly; runs are in order of start and period
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    best = F.when(F.size("runs") > 0, F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), better))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside benchmark windows, from an index over all documents."""
    index = postings.index(_t(spark, sf_dir, "documents"))
    out = postings.report(index, postings.search(index, _t(spark, sf_dir, "benchmark")))
    items = F.col("items")
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


OP12_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (select item_id, w, least(10, len(w)) as k, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0),
win as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as g from p),
ks as (select distinct k from win),
g as (select r, k, i, array_to_string(w[i:i + k - 1], ' ') as g from (select r, k, w, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
m as (select r, item_id, k, i from g join win using (k, g)),
hits as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + k)) as j from (select distinct r, i, k from m)) group by r),
items as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct r, item_id from m where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (r) left join items using (r)
"""


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at line ends and turned round; both digests are taken in the tasks."""
    docs = fim.transform(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    out = fim.restore(docs.select("doc_id", "fim.*"), F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("digest").alias("output_sha256"), F.col("restored.digest").alias("restored_sha256"))


OP13_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, 'null')) as s from documents),
u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as u, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2, ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from d),
c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as z,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from u),
x as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:z], '') as m, array_to_string(u[z + 1:], '') as f from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || f || '<M>' || m else '<S>' || f || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from x
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: globals()[f"OP{k[2:].split('_')[0]}_SQL"] for k in queries() if f"OP{k[2:].split('_')[0]}_SQL" in globals()}
