"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm.collocations import collocations
from tallyhouse.llm.columns import text_or_empty
from tallyhouse.llm.decontamination import contamination
from tallyhouse.llm.extraction import extract_text
from tallyhouse.llm.line_dedup import drop_repeated_lines
from tallyhouse.llm.mixing import pareto_mix
from tallyhouse.llm.near_duplicates import near_duplicates
from tallyhouse.llm.packing import pack_documents
from tallyhouse.llm.prefix_trie import conversation_trie
from tallyhouse.llm.search import every_fiftieth, top_k
from tallyhouse.llm.secret_scan import KINDS, number_of, scan_secrets, spelled
from tallyhouse.llm.ship import ship
from tallyhouse.llm.sharding import shard_rows
from tallyhouse.llm.tokens import token_files
from tallyhouse.llm.toxicity import fit, in_training, toxicity
from tallyhouse.session import tune

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(tune(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pareto_mix(docs, keep_text=False).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text_or_empty("text")) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("_text_hash"))
    return shard_rows(docs, ["doc_id", "_text_hash"], SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("n_chars"),
                       F.sha2("text", 256).alias("text_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = [number_of("base", kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn(
        "n_chars", F.length("text").cast("long"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~in_training("doc_id")).alias("held_out"), "score", "predicted")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files(docs, tokenizer_path(), with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return top_k(docs, docs.filter(every_fiftieth("doc_id"))).select("query_id", "rank", "doc_id", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, tokenizer_path(), with_ids=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Query] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_feistel_shards": op2_feistel_shards,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_secrets": op5_secrets,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_main_text": op7_main_text,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_bm25_top_k": op10_bm25_top_k,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_best_fit_packing": op13_best_fit_packing,
}

# The letters to lower, and what separates words.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text,''),'{_UPPER}','{_LOWER}'),'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE: dict[str, str] = {
    "op4_decontamination": f"""
with d as (select row_number() over () rn, doc_id, {_WORDS} w from documents),
 b as (select coalesce(cast(item_id as varchar),'') item, {_WORDS} w from benchmark),
 win as (select distinct item, least(10,len(w)) n, list_slice(w,p0,p0+least(10,len(w))-1) ws
  from (select item, w, unnest(range(1,len(w)-least(10,len(w))+2)) p0 from b where len(w)>0)),
 sizes as (select distinct n from win),
 grams as (select rn, p0, n, list_slice(w,p0,p0+n-1) ws from (select rn, w, n, unnest(range(1,len(w)-n+2)) p0 from d, sizes where len(w)>=n)),
 hits as (select g.rn, g.p0, g.n, win.item from grams g join win on win.n=g.n and win.ws=g.ws),
 cover as (select rn, count(distinct p) n_hit from (select rn, unnest(range(p0,p0+n)) p from hits) group by rn),
 found as (select rn, count(distinct item) n_items, sha256(string_agg(distinct item, ',' order by item)) h from hits group by rn)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit,0) n_hit, coalesce(n_items,0) n_items, coalesce(h,sha256('')) items_sha256,
 n_hit is not null contaminated
from d left join cover using(rn) left join found using(rn)""",
    "op12_collocations": rf"""
with p as (select coalesce(lang,'und') lang, unnest(regexp_split_to_array(
  translate(coalesce(text,''),'{_UPPER}','{_LOWER}'),'[.,;:!?\x0A-\x0D]')) p from documents),
 w as (select lang, regexp_extract_all(p,'[^\x20\x09]+') w from p),
 f as (select lang, k, list_slice(w,i,i+k-1) ph, count(*) f from (select lang, w, k, unnest(range(1,len(w)-k+2)) i
  from w, (values (1),(2),(3),(4)) s(k)) group by all),
 n as (select lang, cast(sum(f) as bigint) n from f where k=1 group by lang),
 c as (select * from f where k>=2 and f>=30),
 inner_parts as (select lang, f, list_slice(ph,i,i+m-1) ph from (select lang, f, ph, m, unnest(range(1,k-m+2)) i
  from c, (values (2),(3)) s(m) where m<k)),
 longer as (select lang, ph, max(f) m from inner_parts group by all),
 kept as (select c.* from c left join longer using(lang,ph) where m is null or 100*m<80*f),
 cuts as (select lang, ph, f a, unnest(range(1,k)) j from kept),
 scored as (select cuts.lang, cuts.ph, a, j, x.f l, y.f r, cast((2000000::hugeint*a)//(x.f+y.f) as bigint) score
  from cuts join f x on x.lang=cuts.lang and x.ph=list_slice(cuts.ph,1,j) join f y on y.lang=cuts.lang and y.ph=list_slice(cuts.ph,j+1,len(cuts.ph))),
 least as (select * from scored qualify row_number() over (partition by lang, ph order by score, j)=1),
 ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(ph,' ')) rank,
  array_to_string(ph,' ') phrase, a, l, r, score from least)
select lang, rank, phrase, a, l, r, n, score from ranked join n using(lang) where rank<=2000""",
    "op6_near_duplicates": f"""
with recursive d as (select row_number() over () rn, doc_id, regexp_extract_all(translate(coalesce(text,''),'{_UPPER}','{_LOWER}'),
  '[^\\x20\\x09-\\x0D]+') w from documents),
 s as (select rn, doc_id, unnest(list_distinct([list_slice(w,p0,p0+least(5,len(w))-1) for p0 in range(1,len(w)-least(5,len(w))+2)])) g
  from d where len(w)>0),
 n as (select rn, count(*) n from s group by rn),
 common as (select a.rn x, b.rn y, count(*) c from s a join s b on a.g=b.g and a.rn<b.rn group by a.rn,b.rn),
 links as (select x, y from common join n nx on nx.rn=x join n ny on ny.rn=y where 100*c>=75*(nx.n+ny.n-c)),
 both_ways as (select x, y from links union all select y, x from links),
 reach as (select rn, rn other from d union select r.rn, l.y from reach r join both_ways l on l.x=r.other),
 least_id as (select r.rn, min(d.doc_id) component_id from reach r join d on d.rn=r.other group by r.rn)
select d.doc_id, coalesce(n.n,0) n_shingles, component_id, d.doc_id is not distinct from component_id kept
from d join least_id using(rn) left join n on n.rn=d.rn""",
}
