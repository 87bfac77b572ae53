"""Queries over the driver's tables, one for each operator of this subpackage, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (
    bin_slack,
    embed_lsh,
    exact_dedup,
    lm_lattice,
    minhash_fss,
    pfair,
    quality_nbsvm,
    suffix_dedup,
    token_counts,
    toxicity_ssk,
)
from tessera.llm.common import id_crc, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity_ssk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_ssk.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_lattice.score(docs, id_crc() % 7 != 2, tokenizer_file("piece_bpe_32k.model"))


def op3_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_lsh.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.schedule(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_slack.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_counts.section_tokens(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_fss.near_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_ssk": op1_toxicity_ssk,
    "op2_lattice_lm": op2_lattice_lm,
    "op3_quality_nbsvm": op3_quality_nbsvm,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_section_tokens": op9_section_tokens,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": f"""
        with t as (select doc_id, sha256({ASCII_LOWER.format("coalesce(text, '')")}) as text_sha256 from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = max(doc_id) over w as kept, text_sha256
        from t window w as (partition by text_sha256)""",
    "op4_embedding_near_dedup": """
        with recursive e as (
          select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
          where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
              where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93),
        n as (select a, count(*) as n_links from l group by 1),
        reach(a, b) as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a),
        c as (select a, min(b) as least from reach group by 1)
        select vec_id, coalesce(n_links, 0) as n_links, least(vec_id, coalesce(least, vec_id)) as component_id, vec_id <= coalesce(least, vec_id) as kept
        from embeddings left join n on n.a = vec_id left join c on c.a = vec_id""",
    "op8_suffix_dedup": """
        with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
        w as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as w from (select doc_id, h, unnest(range(n - 99)) as i from d where n >= 100)),
        r as (select doc_id, i from w qualify row_number() over (partition by w order by doc_id, i) > 1),
        g as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as island
              from (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 100 then 0 else 1 end as fresh from r)),
        s as (select doc_id, island, min(i) as s, max(i) + 100 as e from g group by 1, 2),
        k as (select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as after from s),
        t as (select doc_id, sum(e - s) as n_removed, count(*) as n_spans, max(e) as stop, string_agg(substr(h, 2 * after + 1, 2 * (s - after)), '' order by s) as head
              from k join d using (doc_id) group by 1)
        select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
               sha256(unhex(case when t.doc_id is null then h else coalesce(head, '') || substr(h, 2 * stop + 1) end)) as kept_sha256
        from d left join t using (doc_id)""",
    "op10_minhash_near_dedup": f"""
        with recursive w as (select doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
        u as (select doc_id, len(s) as n, unnest(s) as x from s),
        p as (select a.doc_id as a, b.doc_id as b from u a join u b on a.x = b.x and a.doc_id < b.doc_id
              group by 1, 2 having 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))),
        l as (select a, b from p union all select b, a from p),
        reach(a, b) as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a),
        c as (select a, min(b) as least from reach group by 1)
        select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(least, doc_id)) as component_id, doc_id <= coalesce(least, doc_id) as kept
        from s left join c on c.a = doc_id""",
}
