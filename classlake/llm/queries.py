"""Registered queries of this subpackage over the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from classlake.llm import (
    byte_bpe, collocation, decontaminate, katz, language_id, maxscore, minhash_forest, mixture, preference, secret_scan,
    shared, suffix_dedup, vector_codes, warc)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- 2: benchmark decontamination
WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION_SQL = f"""
with d as (select doc_id, coalesce({WORDS.format(t='text')}, []) w from documents),
b as (select item_id::varchar item, {WORDS.format(t='text')} w from benchmark where text is not null),
bw as (
  select item, array_to_string(w[s:s + 12], ' ') g, least(len(w), 13) n
  from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) s from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (
  select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s from d, sizes where len(w) >= n)),
hit as (select distinct doc_id, s, n, item from dw join bw using (g, n)),
pos as (select distinct doc_id, unnest(range(s, s + n)) p from hit),
hits as (select doc_id, count(*) n_hit from pos group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) names
        from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(names, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join hits using (doc_id) left join its using (doc_id)"""


@query("op2_decontamination", CONTAMINATION_SQL)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", F.col("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


# ---- 4: language identification (fitted, so it has no SQL twin)
@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


# ---- 7: secrets (positions of pattern matches and token counts have no SQL twin)
@query("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))


# ---- 10: n-gram Jaccard join (tested against brute force; see the tests)
@query("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.similar_classes(table(spark, sf_dir, "documents")).drop("text_hash", "group")


# ---- 3: mixing sources to target weights
MIX_DOMAINS = {"web": ("src0", "src1", "src2", "src3", "src4"), "books": ("src5", "src6", "src7", "src8", "src9"),
               "code": ("src10", "src11", "src12", "src13", "src14")}
MIX_WEIGHTS = {"domain": {"web": 40, "books": 25, "code": 20, "other": 15}, "lang": {"en": 5, "de": 3, "fr": 3, "es": 2},
               "source": {"src0": 2, "src5": 3}}
MIX_SHARE, MIX_EPOCHS = 0.5, 2


def mix_domain(source: str = "source"):
    out = F.lit("forum")
    for name, sources in MIX_DOMAINS.items():
        out = F.when(F.col(source).isin(*sources), name).otherwise(out)
    return out


def _case(column: str, weights: dict[str, int]) -> str:
    whens = "".join(f" when '{k}' then {v}" for k, v in weights.items())
    return f"case {column}{whens} else {weights.get('other', 1)} end"


def _shared(nodes: str, parent: str, name: str) -> str:
    return f"""
      select *, least(capacity, floor(w * max(level) over (partition by {parent}))::bigint) given from (
        select *, (budget - coalesce(sum(capacity) over (o rows between unbounded preceding and 1 preceding), 0))
          / sum(w) over (o rows between current row and unbounded following)::double level
        from (select *, {_case(name, MIX_WEIGHTS[name])} w from ({nodes}) where capacity > 0) where w > 0
        window o as (partition by {parent} order by capacity / w::double, {name}))"""


def mixture_sql(docs: str = "documents") -> str:
    domain = "case " + "".join(
        f"when source in ({', '.join(repr(x) for x in v)}) then '{k}' " for k, v in MIX_DOMAINS.items()) + "else 'forum' end"
    top = _shared("select domain, sum(tokens)::bigint * {e} capacity, any_value(b) budget from leaf, total group by domain".format(
        e=MIX_EPOCHS), "1", "domain")
    langs = _shared(f"select l.domain, l.lang, sum(l.tokens)::bigint * {MIX_EPOCHS} capacity, any_value(t.given) budget "
                    "from leaf l join top t using (domain) group by l.domain, l.lang", "domain", "lang")
    ends = _shared(f"select l.*, l.tokens * {MIX_EPOCHS} capacity, t.given budget from leaf l join langs t using (domain, lang)",
                   "domain, lang", "source")
    return f"""
with d as (
  select * from (
    select doc_id, {domain} as domain, coalesce(lang, 'none') lang, coalesce(source, 'none') source,
      coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0)::bigint n_tokens from {docs}) where n_tokens > 0),
leaf as (select domain, lang, source, sum(n_tokens)::bigint tokens from d group by all),
total as (select floor(sum(tokens) * {MIX_SHARE})::bigint b from leaf),
top as ({top}), langs as ({langs}), ends as ({ends}),
plan as (select domain, lang, source, given // tokens f, given - (given // tokens) * tokens r from ends),
run as (
  select *, sum(n_tokens) over (partition by domain, lang, source order by k, n_tokens rows unbounded preceding) upto
  from (select d.*, f, r, md5('{mixture.SEED}:' || f || ':' || coalesce(doc_id::varchar, '')) k
        from d join plan using (domain, lang, source)))
select doc_id, domain, lang, source, n_tokens, (f + case when upto <= r then 1 else 0 end)::bigint times
from run where f + case when upto <= r then 1 else 0 end > 0"""


@query("op3_mixture", mixture_sql())
def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.choose(table(spark, sf_dir, "documents"), mix_domain(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS)


# ---- 5: chat preference pairs
PREFERENCE_SQL = """
with c as (select conv_id pair_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
           where conv_id is not null),
last as (select pair_id, max(turn) e from c where role = 'assistant' group by pair_id),
ans as (select pair_id, turn e, max(text) answer from c join last using (pair_id)
        where role = 'assistant' and turn = e group by all),
a as (select pair_id, turn, role, text from c join last using (pair_id) where turn <= e),
b as (select pair_id, turn, role, text from c join last using (pair_id) where turn < e
      union all select l.pair_id, l.e, 'assistant', p.answer from last l join ans p on p.pair_id = xor(l.pair_id, 1)),
an as (select *, row_number() over (partition by pair_id order by turn, role, text) - 1 pos from a),
bn as (select *, row_number() over (partition by pair_id order by turn, role, text) - 1 pos from b),
com as (select coalesce(an.pair_id, bn.pair_id) pair_id,
          coalesce(min(case when an.role is distinct from bn.role or an.text is distinct from bn.text
                       then coalesce(an.pos, bn.pos) end), max(coalesce(an.pos, bn.pos)) + 1) n_common
        from an full join bn on an.pair_id = bn.pair_id and an.pos = bn.pos group by 1),
s as (select 'a' side, * from an union all select 'b' side, * from bn),
r as (select s.*, n_common, pos >= n_common rest, '<|im_start|>' || role || chr(10) h,
        text || '<|im_end|>' t from s join com using (pair_id)),
p as (select *, coalesce(sum(length(h) + length(t) + 1) over (partition by side, pair_id, rest order by pos
        rows between unbounded preceding and 1 preceding), 0) + length(h) f from r),
g as (select side, pair_id, rest, string_agg(h || t || chr(10), '' order by pos) txt,
        string_agg(case when role = 'assistant' then f || '-' || (f + length(t)) end, ',' order by pos) spans
      from p group by all)
select com.pair_id conv_id, n_common::bigint n_common, coalesce(q.txt, '') prompt, coalesce(x.txt, '') chosen,
  coalesce(x.spans, '') chosen_spans, coalesce(y.txt, '') rejected, coalesce(y.spans, '') rejected_spans
from com left join g q on q.pair_id = com.pair_id and q.side = 'a' and not q.rest
left join g x on x.pair_id = com.pair_id and x.side = 'a' and x.rest
left join g y on y.pair_id = com.pair_id and y.side = 'b' and y.rest"""


@query("op5_preference_pairs", PREFERENCE_SQL)
def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = preference.contrasted(table(spark, sf_dir, "conversations"))
    return preference.preference_pairs(chosen, rejected).withColumnRenamed("pair_id", "conv_id")


# ---- 8: exact top-k inner products
TOP_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) x from embeddings
  where vec_id is not null and embedding is not null and list_count(embedding) = len(embedding)
    and not list_bool_or(list_transform(embedding, lambda x: not isfinite(x)))),
s as (select q.vec_id query_id, c.vec_id, list_dot_product(q.x::double[], c.x::double[])::bigint score
      from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, rank::int rank, vec_id, score from r where rank <= 5"""


@query("op8_maxscore", TOP_SQL)
def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.scaled(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


# ---- 9: web archives with revisit records
WARC_SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, h, strlen(h) n, sha1(h) digest,
        max(page_id) over (partition by h) last, count(*) over (partition by h) c from p)
select page_id, n::bigint payload_bytes, digest payload_digest,
  case when n >= 1000 and page_id <> last then 'revisit' else 'response' end record_type,
  case when n >= 1000 and page_id <> last then last end refers_to from d"""


@query("op9_warc", WARC_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_archives(spark, path, payloads=False))


# ---- 1: suffix-array dedup (tested against brute force; see the tests)
@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


# ---- 6: scores under a Katz backoff model (tested against brute force; see the tests)
@query("op6_katz_scores")
def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = katz.katz_scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


# ---- 11: byte-level BPE (tested against the library; see the tests)
@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.decode(byte_bpe.encode(docs).select("doc_id", "ids"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


# ---- 12: phrase collocations
PHRASE_SQL = r"""
with p as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
words as (select lang, sum(len(w))::bigint n from w group by lang),
f as (
  select lang, k, array_to_string(w[s:s + k - 1], ' ') phrase, count(*)::bigint a
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) s from w, range(1, 5) t(k) where len(w) >= k)
  group by all having count(*) >= 30),
c as (select lang, k, phrase, a, string_split(phrase, ' ') w from f where k > 1),
cuts as (
  select lang, phrase, a, cut, array_to_string(w[:cut], ' ') lp, array_to_string(w[cut + 1:], ' ') rp
  from (select *, unnest(range(1, k)) cut from c)),
scored as (
  select cuts.lang, cuts.phrase, cuts.a, cut, x.a l, y.a r, (2000000::hugeint * cuts.a) // (x.a::hugeint + y.a) score
  from cuts join f x on x.lang = cuts.lang and x.phrase = lp join f y on y.lang = cuts.lang and y.phrase = rp),
best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_parts as (
  select lang, array_to_string(w[i:i + z - 1], ' ') phrase, max(a) longer
  from (select *, unnest(range(1, k - z + 2)) i from (select *, unnest(range(2, k)) z from c where k > 2)) group by all),
ranked as (
  select best.lang, best.phrase, a, l, r, score::bigint score,
    row_number() over (partition by best.lang order by score desc, a desc, best.phrase) rank
  from best left join inner_parts o on o.lang = best.lang and o.phrase = best.phrase
  where longer is null or 100::hugeint * longer < 80::hugeint * a)
select ranked.lang, rank, phrase, a, l, r, n, score from ranked join words on words.lang = ranked.lang where rank <= 2000"""


@query("op12_collocations", PHRASE_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents")).drop("cut")


# ---- 13: vector code compression
def _codes_sql(entries: int = 256, rounds: int = 4) -> str:
    """One assignment and one new codebook after the other; the digest is a list of all entries."""
    steps = ["""
v as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) x from embeddings
      where embedding is not null and list_count(embedding) = len(embedding)
        and not list_bool_or(list_transform(embedding, lambda x: not isfinite(x)))),
p as (select vec_id, label, pos, x[pos * len(x) // 4 + 1:(pos + 1) * len(x) // 4] x from v, range(0, 4) t(pos)),
o as (select vec_id, row_number() over (order by vec_id) - 1 e from v),
c0 as (select pos, e, x from p join o using (vec_id) where e < %d)""" % entries]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} as materialized (
  select vec_id, label, pos, any_value(x) x, min(struct_pack(d := d, e := e)) best
  from (select p.*, e, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d
        from p join c{k} c using (pos))
  group by vec_id, label, pos)""")
        if k < rounds:
            steps.append(f"""
m{k} as (select pos, e, list(s order by i) x from (
  select pos, best.e e, i, floor(sum(x[i]) / count(*)) s from a{k}, range(1, (select max(len(x)) from a{k}) + 1) t(i)
  group by pos, best.e, i) group by pos, e),
c{k + 1} as materialized (select pos, e, coalesce(m.x, c.x) x from c{k} c left join m{k} m using (pos, e))""")
    return "with" + ",".join(steps) + f""",
code as (
  select vec_id, label, string_agg(lower(lpad(to_hex(best.e::bigint), 2, '0')), '' order by pos) code, sum(best.d)::bigint error
  from a{rounds} group by vec_id, label),
book as (select sha256(string_agg(array_to_string(list_transform(x, lambda z: z::bigint), ','), ',' order by pos, e)) codebooks_sha256
         from c{rounds})
select vec_id, code, error, sum(error) over (partition by label)::bigint label_error, codebooks_sha256 from code, book"""


@query("op13_vector_codes", _codes_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error",
                        F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))
