"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
QUALITY_AT = 0.3
TOXIC_AT = 0.3


def held_out(doc_id: str) -> Column:
    """Whether a row is kept for tests, by the checksum of its id as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from tallystone.llm.subword_quality import quality_model, score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(docs, table(spark, sf_dir, "labels"), ~held_out("id"))
    return score_texts(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= QUALITY_AT).cast("int").alias("predicted"))


@register
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of cross-document line frequency."""
    from tallystone.llm.line_frequency import line_frequency

    return line_frequency(table(spark, sf_dir, "documents"))


@register
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document contains to four fifths or more."""
    from tallystone.llm.containment import contained_items

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contained_items(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("_items").cast("long").alias("n_items"), (F.size("_items") > 0).alias("contaminated"),
                        F.col("_items").alias("items"), F.col("_containment").alias("containment"))


@register
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    from tallystone.llm.dart_minhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links")


@register
def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's token ids, read back from record files."""
    import public_tokenizers

    from tallystone.llm.token_records import token_records

    read = token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a passage of a document with a smaller id, taken out."""
    from tallystone.llm.substring_dedup import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
                                       F.sha2("_kept", 256).alias("kept_sha256"))


@register
def op5_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, with inclusion scores and the round trip."""
    import public_tokenizers

    from tallystone.llm.piece_sampling import sample_segmentations

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), F.col("doc_id")).select(
        "doc_id", F.size("_samples").cast("long").alias("n_samples"), F.col("_samples.n_pieces").alias("n_pieces"),
        F.transform("_samples", lambda s: F.crc32(s["ids"])).alias("ids_crc32"), F.col("_samples.log_prob").alias("log_prob"),
        F.col("_samples.log_inclusion").alias("log_inclusion"), F.col("_round_trip").alias("round_trip"))


@register
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from tallystone.llm.cut_extraction import extract_main_text

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", F.col("_main_text").alias("text"), F.length("_main_text").cast("long").alias("n_chars"))


@register
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that lines, paragraphs or the whole text of each document state."""
    from tallystone.llm.license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.array_max(F.col("_licenses.dice"))
    return found.select("doc_id", F.size("_licenses").cast("long").alias("n_licenses"), F.col("_licenses.license").alias("licenses"), best.alias("dice"))


@register
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained probabilities of low quality and of toxicity for every document."""
    from tallystone.llm.toxicity_chain import score_toxicity, toxicity_chain

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    chain = toxicity_chain(docs, labels, ["low_quality", "toxic"])
    p = F.col("_probabilities")
    return score_toxicity(docs, chain).select("doc_id", p[0].alias("p_low_quality"), p[1].alias("p_toxic"), (p[1] >= TOXIC_AT).cast("int").alias("toxic"))


@register
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, the longest of them, and the text without the repetitions."""
    from tallystone.llm.periodic_runs import find_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_runs(docs, plant=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    best = F.array_sort("_runs", lambda a, b: F.coalesce(
        *(F.when(x < y, -1).when(x > y, 1) for x, y in ((b["length"], a["length"]), (a["start"], b["start"]), (a["period"], b["period"]))), F.lit(0)))
    best = F.get(best, F.lit(0))
    lines = F.array_join(F.transform("_runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("_runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.when(F.size("_runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("_collapsed", 256).alias("collapsed_sha256"))


@register
def op12_byte_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under a byte model of the training documents, beside a unigram base."""
    from tallystone.llm.byte_ppm import ppm_scores

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ppm_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its text still belongs to the manifest after half of them lost their line feeds."""
    from tallystone.llm.merkle_manifest import merkle_manifest, prove, row_digest

    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    # a text without a line feed keeps its leaf: one digest serves both
    changed = tampered & F.contains("text", F.lit("\n"))
    leaf = row_digest(*columns, F.col("text"))
    leaves = docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), leaf.alias("digest"),
                         F.when(changed, row_digest(*columns, F.replace("text", F.lit("\n"), F.lit("")))).alias("lost"))
    leaves = leaves.select("grp", "id", "digest", F.coalesce("lost", "digest").alias("claim"))
    return prove(*merkle_manifest(leaves), "claim").select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
        F.col("holds").alias("verified"))


#: crc32 of the id bit by bit, the trees level by level, then every leaf upwards beside its siblings
ORACLES["op11_merkle_manifest"] = r"""
with recursive
bits as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1))) as t),
docs as (
  select d.*, row_number() over () as tie,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc
  from documents d, bits),
framed as (
  select doc_id, source, tie,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
         text, if(crc % 2 = 0, replace(text, chr(10), ''), text) as lost
  from docs),
hashed as (
  select doc_id, source, tie, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
         sha256(head || coalesce(strlen(lost) || ':' || lost, '-')) as claim from framed),
leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf, tie) - 1 as pos, count(*) over (partition by source) as n from hashed),
tree(source, level, pos, n, digest) as (
  select source, 0, pos, n, leaf from leaves
  union all
  select source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by pos)) from tree where n > 1 group by source, level, pos // 3, n),
subroots as (
  select source, digest as subroot, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from tree where n = 1),
crown(level, pos, n, digest) as (
  select 0, pos, n, subroot from subroots
  union all
  select level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by pos)) from crown where n > 1 group by level, pos // 3, n),
walk(tie, source, part, level, pos, n, proof, folded) as (
  select tie, source, 0, 0, pos, n, '', claim from leaves
  union all
  select * from (
    with sides as (
      select w.tie, w.source, w.part, w.level, w.pos, w.n, w.proof, w.folded,
             coalesce(string_agg(d.digest, '' order by d.pos) filter (d.pos < w.pos), '') as l,
             coalesce(string_agg(d.digest, '' order by d.pos) filter (d.pos > w.pos), '') as r
      from walk w join (select 0 as part, source, level, pos, digest from tree union all select 1, null, level, pos, digest from crown) d
        on d.part = w.part and d.level = w.level and d.pos // 3 = w.pos // 3 and (w.part = 1 or d.source is not distinct from w.source)
      where w.n > 1 group by all)
    select tie, source, part, level + 1, pos // 3, (n + 2) // 3, proof || l || r, sha256(l || folded || r) from sides
    union all
    select w.tie, w.source, 1, 0, s.pos, s.n, w.proof, w.folded from walk w join subroots s on s.source is not distinct from w.source
    where w.n = 1 and w.part = 0 and s.n > 1))
select h.doc_id, h.leaf, s.subroot, c.digest as root, sha256(w.proof) as proof_sha256, w.folded as folded_root, w.folded = c.digest as verified
from hashed h join walk w using (tie) join subroots s on s.source is not distinct from h.source cross join (select digest from crown where n = 1) c
where w.n = 1 and (w.part = 1 or s.n = 1)
"""
