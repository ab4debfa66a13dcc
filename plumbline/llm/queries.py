"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import alignment, ann, cross_polytope, divergence, hamming, lm, packing, quality, quotes, secrets, suffix, token_files, tokenizer

#: The published byte-level BPE file; another path may be set.
BPE = public_tokenizers.path("byte_bpe_50k.json")
#: The published SentencePiece model that op12 aligns it with.
PIECE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), BPE)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_inner_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(table(spark, sf_dir, "conversations"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hamming.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = tokenizer.decode(tokenizer.encode(docs, BPE).drop("text"), BPE)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_found", lambda s: s["kind"] < len(secrets.BASE))

    def count(place: int) -> Column:
        return F.size(F.filter("_found", lambda s: s["kind"] == place)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("_found")).alias("spans"))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"), BPE, PIECE)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_files.documents(token_files.write(table(spark, sf_dir, "documents"), BPE))
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def _op7_sql() -> str:
    """Each rule's matches from what a split leaves between them, as lists."""
    rules = []
    for i, r in enumerate(secrets.RULES):
        pattern = r.regex.replace("'", "''")
        rules.append(f"""
          select row, {i} as kind, unnest(list_transform(range(1, len(m) + 1), lambda k: {{
              'a': list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0),
              'n': length(m[k]), 'g': length(g[k])}})) as s
          from (select row, string_split_regex(text, '{pattern}') as b, regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {r.group}) as g from docs) where len(m) > 0""")
    names = "[" + ", ".join(f"'{r.kind}'" for r in secrets.RULES) + "]"
    least = "[" + ", ".join(str(r.least) for r in secrets.RULES) + "]"
    return f"""
      with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
      spans as (select row, kind, s.a::bigint as a, (s.a + s.n)::bigint as e from ({' union all '.join(rules)}) where s.g >= ({least})[kind + 1]),
      named as (select row, kind, a, ({names})[kind + 1] || ':' || a || ':' || e as one from spans),
      per as (select row, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
              coalesce(string_agg(one, ',' order by a, kind) filter (kind < 3), '') as base, string_agg(one, ',' order by a, kind) as spans from named group by row)
      select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
             sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
      from docs left join per using (row)"""


#: Usable vectors, one row of equal ones with equal ids, as doubles.
VECTORS_SQL = """v as (select distinct vec_id::bigint as vec_id, embedding::double[] as x from embeddings where vec_id is not null and embedding is not null
        and list_bool_and(list_transform(embedding, lambda c: c is not null and isfinite(c))) and list_bool_or(list_transform(embedding, lambda c: c <> 0)))"""
OP8_SQL = f"""
      with {VECTORS_SQL},
      s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x) as score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.x) = len(c.x)),
      r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
      select query_id, rank::int as rank, vec_id, score from r where rank <= 20"""


#: Rows as they come, each a vector; links by cosine, components by what links reach.
OP3_SQL = """
      with recursive v as (select row_number() over () as row, vec_id::bigint as vec_id, embedding::double[] as x,
             coalesce(list_bool_and(list_transform(embedding, lambda c: c is not null and isfinite(c))) and list_bool_or(list_transform(embedding, lambda c: c <> 0)), false) as fine from embeddings),
      links as (select p.row as a, q.row as b from v p join v q on p.fine and q.fine and p.row <> q.row and len(p.x) = len(q.x) and list_cosine_similarity(p.x, q.x) >= 0.95),
      reach as (select row as a, row as b from v union select r.a, l.b from reach r join links l on r.b = l.a),
      least as (select r.a, min(v.vec_id) as component_id from reach r join v on r.b = v.row group by r.a),
      degree as (select a, count(*) as n from links group by a)
      select vec_id, coalesce(n, 0)::bigint as n_links, component_id, coalesce(vec_id = component_id, true) as kept
      from v join least on v.row = least.a left join degree on v.row = degree.a"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: All kept terms of all groups, zero counts as well, and all pairs of groups over them.
OP11_SQL = f"""
      with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
      t as (select row, lang, source, unnest(w) as term from d),
      kept as (select lang, term, count(*) as n from t group by lang, term having count(distinct row) >= 3),
      v as (select lang, count(*) as v, sum(n) as n from kept group by lang),
      g as (select distinct lang, source from d),
      c as (select lang, source, term, count(*) as n from t group by all),
      full_c as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join kept k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
      sums as (select lang, source, sum(n) as n from full_c group by all),
      p as (select f.lang, f.source, f.term, f.n as count, (1 + (1000000000::hugeint * (f.n + 1)) // (s.n + v.v))::hugeint as p
            from full_c f join sums s on f.lang = s.lang and f.source = s.source join v on v.lang = f.lang),
      q as (select kept.lang, term, (1 + (1000000000::hugeint * (kept.n + 1)) // (v.n + v.v))::hugeint as q from kept join v using (lang)),
      far as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
      pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(far.value, 0) as value
                from g a join g b on a.lang = b.lang and a.source <> b.source left join far on far.lang = a.lang and far.source = a.source and far.item = b.source),
      terms as (select p.lang, p.source, 'term' as part, p.term as item, (p.p - q.q) * (p.p - q.q) // q.q as value from p join q on p.lang = q.lang and p.term = q.term where p.count > 0 and p.p > q.q),
      ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
      select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 200"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": OP3_SQL, "op7_secret_scan": _op7_sql(), "op8_inner_product_search": OP8_SQL, "op11_source_divergence": OP11_SQL}
