"""Queries of the operators for text, by the names of the driver's contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bandloom.common import table
from bandloom.llm import canon, encoding, leaks, matching, mixing, neighbours, reading


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(table(spark, sf_dir, "samples"), table(spark, sf_dir, "ecostress_samples"), "sampleid", "name", "samplenum", "origin")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select(F.col("key_a").alias("sampleid_a"), F.col("key_b").alias("sampleid_b")).distinct()


def p2_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with the cosine of their vectors and the confidence that it is calibrated to."""
    return _matched(spark, sf_dir).select(F.col("key_a").alias("sampleid_a"), F.col("key_b").alias("sampleid_b"), F.round("cosine", 4).alias("cosine"), F.round("confidence", 4).alias("confidence"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectra = table(spark, sf_dir, "spectra")
    return canon.map_columns(
        {
            ("spectra", "spectrumid", "instrument"): spectra,
            ("spectra", "spectrumid", "yunit"): spectra,
            ("usgs_samples", "sampleid", "spectrometer"): table(spark, sf_dir, "usgs_samples"),
        },
        table(spark, sf_dir, "canon_terms"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).where("not letter_for_letter").select("tab", "recordid", "field", "termid").distinct()


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean no entry, with how many records hold each."""
    return _mapped(spark, sf_dir).where("termid = 0").groupBy("field", "value").agg(F.countDistinct("tab", "recordid").alias("n_records"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spectra = table(spark, sf_dir, "spectra").select("spectrumid", "numvalues", "ydata")
    near = neighbours.nearest(spectra, "spectrumid", "ydata", "numvalues", k=5, min_similarity=0.995)
    return near.select(F.least("id", "neighbour").alias("spectrumid_a"), F.greatest("id", "neighbour").alias("spectrumid_b")).distinct()


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every embedding, whatever their similarity: exact, from all pairs."""
    near = neighbours.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return near.select("id", "neighbour", F.round("similarity", 4).alias("similarity"), "rank")


def _garbled(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts: DataFrame | None = None
    for tab in ("samples", "ecostress_samples"):
        t = table(spark, sf_dir, tab).select(F.lit(tab).alias("tab"), "sampleid", F.explode(F.create_map(F.lit("name"), F.col("name"), F.lit("description"), F.col("description"))).alias("field", "text"))
        texts = t if texts is None else texts.unionByName(t)
    return encoding.find_garbled(texts, ["tab", "sampleid", "field"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _garbled(spark, sf_dir).select("tab", "sampleid", "field").distinct()


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled texts with the original as far as it can still be had."""
    return _garbled(spark, sf_dir)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("item_id", "doc_id").distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the number of documents that repeat it and its longest repeated run."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest_run"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in the mixture of the target shares."""
    m = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return m.select("doc_id", "source", "tokens", F.round("rate", 4).alias("rate"), "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mixture reached beside those wanted."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated level of each page with English running text."""
    levels = reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))
    return levels.select("doc_id", F.round("level", 3).alias("level"), "step")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))
    return levels.where("step = 5").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_confidence, p3_found, p3_unmatched, p4_found, p4_nearest, p6_found, p6_restored, p7_found, p7_items, p8_mixture, p8_shares, p9_found, p9_levels)}
#: All spans of 12 words of both sides, joined; runs of hits on one diagonal are the repeated passages.
_SPANS = r"""with parts as (select distinct item_id, part, text from (select item_id, 'passage' as part, passage as text from eval_items union all select item_id, 'question', question from eval_items) where item_id is not null and text is not null),
iw as (select item_id, part, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from parts), dw as (select distinct doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where doc_id is not null and text is not null),
ip as (select item_id, part, w, unnest(range(1, len(w) - 10)) as i from iw where len(w) >= 12), dp as (select doc_id, w, unnest(range(1, len(w) - 10)) as d from dw where len(w) >= 12),
ig as (select item_id, part, i, hash(w[i:i + 11]) as g from ip), dg as (select doc_id, d, hash(w[d:d + 11]) as g from dp),
hits as (select distinct doc_id, item_id, part, d, i from dg join ig using (g)),
runs as (select doc_id, item_id, part, d - i as diagonal, i - row_number() over (partition by doc_id, item_id, part, d - i order by i) as island from hits),
spans as (select doc_id, item_id, part, count(*) + 11 as n_words from runs group by doc_id, item_id, part, diagonal, island)"""
#: Cosines in double of all pairs of one length.
_COSINE = "list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))"
_SPECTRA = "with s as (select spectrumid as id, numvalues as g, ydata::double[] as v from spectra where spectrumid is not null and numvalues is not null and len(ydata) > 0 and len(list_filter(ydata, lambda e: e is null or isnan(e))) = 0), q as (select distinct * from s where list_inner_product(v, v) > 0)"
ORACLES: dict[str, str] = {
    "p7_found": _SPANS + " select distinct item_id, doc_id from spans",
    "p7_items": _SPANS + " select item_id, cast(count(distinct doc_id) as bigint) as n_documents, cast(max(n_words) as int) as longest_run from spans group by item_id",
    "p4_nearest": f"""with e as (select vec_id as id, embedding::double[] as v from embeddings), p as (select a.id, b.id as neighbour, {_COSINE} as similarity from e a join e b on a.id <> b.id),
r as (select *, row_number() over (partition by id order by round(similarity, 12) desc, neighbour) as rank from p) select id, neighbour, round(similarity, 4) as similarity, cast(rank as int) as rank from r where rank <= 5""",
    "p4_found": f"""{_SPECTRA}, p as (select a.id, b.id as neighbour, max({_COSINE}) as similarity from q a join q b on a.g = b.g and len(a.v) = len(b.v) and a.id <> b.id group by a.id, b.id),
r as (select *, row_number() over (partition by id order by round(similarity, 9) desc, neighbour) as rank from p) select distinct least(id, neighbour) as spectrumid_a, greatest(id, neighbour) as spectrumid_b from r where rank <= 5 and similarity >= 0.995""",
}
