"""The registered queries of the text operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, line_dedup, lm, merkle, near_dedup, packing, periodic, phrases, token_files, toxicity
from .common import held_out_crc, read
from .url_filter import judge_urls

#: The rules of the url query: host, path, verdict (fixed values).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.sql("values " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)).toDF("host", "path", "verdict")
    return judge_urls(rules, pages).select("page_id", "host", "path", "rule", "verdict")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(read(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.render(read(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", "n_copies", F.length("chat").cast("long").alias("n_chars"), F.md5(F.col("chat").cast("binary")).alias("chat_md5"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("clean_text", F.lit("")).cast("binary")).alias("clean_md5"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out_crc(F.col("doc_id"), 4, 2)
    model = toxicity.fit(toxicity.sampled(docs, read(spark, sf_dir, "labels").where(~held)))
    return toxicity.score(docs, model, 0.3).select("doc_id", held.alias("held_out"), "score", "predicted")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.when(held_out_crc(F.col("doc_id"), 7, 0), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    leaf = lambda n: merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    rows = docs.select("doc_id", merkle.tree_key(F.col("lang")).alias("tree"), leaf(F.col("n_chars")).alias("leaf"), leaf(tampered).alias("claimed"))
    out = merkle.manifest(rows, ["doc_id"]).withColumn("folded_root", merkle.fold(F.col("claimed"), F.col("steps")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a tenth of the texts gets a periodic end
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def ended(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")).otherwise(F.lit(""))

    # the array around the words keeps them from being split again for every word
    text = F.when(h % 10 == 0, F.get(F.transform(F.array(words), ended), F.lit(0))).otherwise(F.col("text"))
    out = periodic.periodic_runs(read(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = out.withColumn("best", best).select("doc_id", "best", F.size("runs").cast("long").alias("n_runs"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    start, period = -F.col("best.start"), -F.col("best.period")
    return out.select("doc_id", "n_runs", start.alias("start"), F.col("best.length").alias("length"), period.alias("period"), F.floor(1000 * F.col("best.length") / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    return phrases.compare_with_next(read(spark, sf_dir, "documents").select("doc_id", "text"), edited)


def queries() -> dict:
    made = [op1_url_filter, op2_token_files, op3_chat_format, op4_line_dedup, op5_lm_score, op6_toxicity, op7_exact_dedup, op8_decontaminate, op9_pack, op10_near_dedup, op11_merkle, op12_periodic_runs, op13_fingerprints]
    return {f.__name__: f for f in made}


_URL = """
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), raw as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from cut
), parts as (
  select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from raw
), rules(rhost, rpath, v) as (values {rules}
), fits as (
  select page_id, rhost || rpath as rule, v,
         row_number() over (partition by page_id order by length(rhost || rpath) desc) as k
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') as verdict
from parts p left join fits f on p.page_id = f.page_id and f.k = 1
"""

_CHAT = """
with said as (
  select conv_id, row_number() over (partition by conv_id order by turn, role nulls first, text nulls first) as place,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) as t
  from conversations
), whole as (
  select conv_id, count(*) as n, list(t order by place) as ts from said group by conv_id
), kinds as (
  select ts, n, min(conv_id) as conv_id, count(*) as copies from whole group by ts, n
), inner_ as (
  select distinct ts[1:k] as ts from (select ts, unnest(range(1, n)) as k from kinds)
)
select conv_id, n as n_turns, copies as n_copies, length(array_to_string(ts, '')) as n_chars, md5(array_to_string(ts, '')) as chat_md5
from kinds where ts not in (select ts from inner_)
"""

_LINE = """
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as pos from documents
), trimmed as (
  select *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line from lines
), bad as (
  select line from trimmed where line <> '' group by line having count(distinct coalesce('+' || source, '')) >= 10
), marked as (
  select doc_id, pos, raw, line, line in (select line from bad) as gone from trimmed
), made as (
  select doc_id, count(*) filter (line <> '') as n_lines, count(*) filter (gone) as n_removed,
         coalesce(string_agg(raw, chr(10) order by pos) filter (not gone), '') as clean
  from marked group by doc_id
)
select d.doc_id, coalesce(m.n_lines, 0) as n_lines, coalesce(m.n_removed, 0) as n_removed, md5(coalesce(m.clean, '')) as clean_md5
from documents d left join made m on d.doc_id = m.doc_id
"""

_EXACT = """
with t as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size, sha256(t) as s from t group by t)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, g.s as text_sha256 from t join g using (t)
"""


_LEAK = """
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {upper}), {word}) as w from documents),
iw as (select cast(item_id as varchar) as item, regexp_extract_all(translate(text, {upper}), {word}) as w from benchmark where text is not null),
win as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as s
        from (select item, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from iw where len(w) > 0)),
kinds as (select distinct n from win),
words as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos from dw),
runs as (select doc_id, pos, list(word) over (partition by doc_id order by pos rows between current row and 9 following) as ws from words),
hits as (select distinct r.doc_id, r.pos, k.n, v.item from runs r join kinds k on len(r.ws) >= k.n join win v on v.n = k.n and v.s = array_to_string(r.ws[1:k.n], ' ')),
marked as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as p from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(m.n_hit, 0) as n_hit, coalesce(f.n_items, 0) as n_items, sha256(coalesce(f.names, '')) as items_sha256, coalesce(m.n_hit, 0) > 0 as contaminated
from dw d left join marked m using (doc_id) left join found f using (doc_id)
"""

_NEAR = """
with recursive dw as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {upper}), '[^\\x20\\x09-\\x0D]+') as w from documents),
words as (select doc_id, unnest(w) as word, unnest(range(len(w))) as pos, len(w) as n from dw),
runs as (select doc_id, pos, n, list(word) over (partition by doc_id order by pos rows between current row and 4 following) as ws from words),
sets as materialized (select distinct doc_id, array_to_string(ws, ' ') as s from runs where len(ws) = least(n, 5)),
sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
pairs as materialized (select a.doc_id as a, b.doc_id as b, count(*) as k from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
links as materialized (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on l.a = r.b)
select r.a as doc_id, coalesce(any_value(z.n), 0) as n_shingles, min(r.b) as component_id, min(r.b) = r.a as kept from reach r left join sizes z on z.doc_id = r.a group by r.a
"""


#: crc32 of a decimal number, by bytes.
_CRC = """
crc_steps as (select i, i as c, 0 as k from range(256) r(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_steps where k < 8),
crc_table as (select list(c order by i) as t from crc_steps where k = 8),
crcs as (select doc_id, xor(list_reduce(list_prepend(4294967295, [ascii(x) for x in string_split(cast(doc_id as varchar), '')]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as h
         from (select distinct doc_id from documents where doc_id is not null), crc_table)
"""

_MERKLE = """
with recursive {crc},
d as materialized (select row_number() over () as r, coalesce('+' || lang, '') as tree, doc_id, source, lang, n_chars, text, n_chars + (coalesce(h % 7, 1) = 0)::int as told from documents left join crcs using (doc_id)),
leaves as materialized (
  select r, tree, doc_id, sha256({leaf}) as leaf, sha256({claimed}) as claimed from d
), placed as materialized (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as p from leaves
), levels as materialized (
  select tree, 0 as l, list(leaf order by p) as ns from placed group by tree
  union all
  select tree, l + 1, [sha256(array_to_string(ns[2 * i + 1 : 2 * i + 2], '')) for i in range((len(ns) + 1) // 2)] from levels where len(ns) > 1
), subs as materialized (select tree, ns[1] as subroot, l as height, row_number() over (order by tree) - 1 as q from levels where len(ns) = 1),
tops as materialized (
  select 0 as l, list(subroot order by q) as ns from subs
  union all
  select l + 1, [sha256(array_to_string(ns[2 * i + 1 : 2 * i + 2], '')) for i in range((len(ns) + 1) // 2)] from tops where len(ns) > 1
), steps as materialized (
  select r, v.l as k, (p >> v.l) & 1 as right_, coalesce(ns[xor(p >> v.l, 1) + 1], '') as sib from placed join levels v using (tree) where len(ns) > 1
  union all
  select r, height + v.l, (q >> v.l) & 1, coalesce(ns[xor(q >> v.l, 1) + 1], '') from placed join subs using (tree), tops v where len(ns) > 1
), proof as (select r, string_agg(sib, '' order by k) as sibs from steps group by r),
folds as (
  select r, 0 as k, claimed as x from placed
  union all
  select r, k + 1, sha256(case when right_ = 1 then sib || x else x || sib end) from folds join steps using (r, k)
), folded as (select r, arg_max(x, k) as folded_root from folds group by r)
select doc_id, leaf, subroot, ns[1] as root, sha256(coalesce(sibs, '')) as proof_sha256, folded_root, folded_root = ns[1] as verified
from placed join subs using (tree) left join proof using (r) join folded using (r), (select ns from tops where len(ns) = 1)
"""


_PERIODIC = """
with recursive {crc},
plain as (select row_number() over () as r, doc_id, coalesce(h, 1) as h, coalesce(h, 1) // 10 as g, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents left join crcs using (doc_id)),
cut as (select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then g % len(w) end as a from plain),
docs as materialized (
  select r, doc_id, case when a is null then w else [w[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end + 1] for i in range(n)] end as w from cut
), words as materialized (select r, unnest(w) as word, unnest(range(len(w))) as i from docs),
grams as materialized (
  select r, i, string_agg(word, ' ') over (partition by r order by i rows between current row and 5 following) as s, count(*) over (partition by r order by i rows between current row and 5 following) as k from words
), same as (select a.r, a.i, b.i - a.i as q from grams a join grams b on a.r = b.r and a.s = b.s and a.i < b.i where a.k = 6 and b.k = 6),
stretch as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from same),
found as (select r, q, min(i) as s, count(*) + 5 + q as l from stretch group by r, q, island),
runs as materialized (select r, s, l, min(q) as q from found where l >= greatest(12, 2 * q) group by r, s, l),
told as (select r, count(*) as n_runs, arg_min({s: s, l: l, q: q}, row(-l, s, q)) as best, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as lines from runs group by r),
gone as (select distinct r, unnest(range(s + q, s + l)) as i from runs),
kept as (select r, string_agg(word, ' ' order by i) as t from words anti join gone using (r, i) group by r)
select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.l as length, best.q as period, 1000 * best.l // best.q as exponent_milli,
       sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from docs left join told using (r) left join kept using (r)
"""


def _leaf_sql(n: str) -> str:
    return " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", n, "text"))


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    upper, word = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    leak, near = _LEAK.replace("{upper}", upper).replace("{word}", word), _NEAR.replace("{upper}", upper)
    return {"op8_decontaminate": leak, "op10_near_dedup": near, "op1_url_filter": _URL.replace("{rules}", rules), "op3_chat_format": _CHAT, "op4_line_dedup": _LINE, "op7_exact_dedup": _EXACT, "op12_periodic_runs": _PERIODIC.replace("{crc}", _CRC), "op11_merkle": _MERKLE.replace("{crc}", _CRC).replace("{leaf}", _leaf_sql("n_chars")).replace("{claimed}", _leaf_sql("told"))}
