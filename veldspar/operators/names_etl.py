"""The names dataset: evidence -> normal forms -> lexicon and candidates -> review -> published groups."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions import similarity

RAW = "source string, source_id string, source_license string, name_raw string, name_type string, country_iso2 string, language_tag string, evidence_count int, fetched_at timestamp"
WEST, EAST = ("NG", "GH", "SN", "GM", "SL", "LR", "GN", "ML", "NE"), ("KE", "UG", "TZ", "ET", "SO", "ER", "RW")
NORMAL = "struct<name_display:string,name_nfc:string,name_ascii_key:string,script:string,was_trimmed:boolean,was_casefolded:boolean,had_diacritics:boolean,contains_apostrophe:boolean,contains_hyphen:boolean>"
_EDGES = "'\".,;:!?[]{} \t\n\r\x0b\x0c"
_DESCRIPTOR = re.compile(r"\s*\((?:(?:family|given|first|last)\s+name|surname|name)\)?\s*$", re.IGNORECASE)


def dedupe(raw: DataFrame) -> DataFrame:
    """One row for each (source, id, folded name, type, country): evidence added up, other fields of the earliest row."""
    key = [F.col("source"), F.col("source_id"), F.lower("name_raw").alias("folded"), F.col("name_type"), F.col("country_iso2")]
    rest = F.struct("fetched_at", "name_raw", "source_license", "language_tag")
    out = raw.groupBy(*key).agg(F.min(rest).alias("r"), F.sum("evidence_count").cast("int").alias("evidence_count"))
    return out.select("source", "source_id", "r.source_license", "r.name_raw", "name_type", "country_iso2", "r.language_tag", "evidence_count", "r.fetched_at")


def invalid(raw: DataFrame) -> DataFrame:
    """Rows that break the evidence schema, with what is wrong with each."""
    errors = """filter(array(if(coalesce(source, '') = '', 'source is empty', null), if(coalesce(name_raw, '') = '', 'name_raw is empty', null), if(coalesce(name_type, '') not in ('given', 'family'), 'name_type is not given or family', null),
        if(not coalesce(country_iso2, '') rlike '^[A-Z]{2}$', 'country_iso2 is not two capitals', null), if(coalesce(evidence_count, 0) < 1, 'evidence_count is below 1', null)), e -> e is not null)"""
    return raw.withColumn("errors", F.expr(errors)).where("size(errors) > 0")


def normal_form(name: str) -> dict:
    cleaned = " ".join(_DESCRIPTOR.sub("", " ".join(name.strip().strip(_EDGES).split())).split())
    nfc = unicodedata.normalize("NFC", cleaned)
    folded = nfc.casefold()
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return {
        "name_display": cleaned, "name_nfc": nfc, "name_ascii_key": re.sub("[^a-z0-9]+", "", plain(folded)) or "unknown",
        "script": "latin_extended" if any(ord(c) > 127 for c in nfc if c.isalpha()) else "latin", "was_trimmed": cleaned != name, "was_casefolded": folded != nfc,
        "had_diacritics": nfc != plain(nfc), "contains_apostrophe": "'" in nfc, "contains_hyphen": "-" in nfc,
    }


def _normal(column: Column) -> Column:
    kind = pa.struct([("name_display", pa.string()), ("name_nfc", pa.string()), ("name_ascii_key", pa.string()), ("script", pa.string()), *((f, pa.bool_()) for f in ("was_trimmed", "was_casefolded", "had_diacritics", "contains_apostrophe", "contains_hyphen"))])

    @F.arrow_udf(NORMAL)
    def run(names: pa.Array) -> pa.Array:
        return pa.array([normal_form(n or "") for n in names.to_pylist()], kind)

    return run.asNondeterministic()(column)  # one call for all fields


def normalize(raw: DataFrame) -> DataFrame:
    """Evidence rows with display, NFC, key and flags instead of the raw name."""
    return raw.withColumn("_n", _normal(F.col("name_raw"))).select(*[c for c in raw.columns if c != "name_raw"], "_n.*")


def _piped(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), "|")


def lexicon(normal: DataFrame) -> DataFrame:
    """One row a (key, type): the best form (most evidence, shortest, first), all sources, totals."""
    best = F.min(F.struct((-F.col("evidence_count")).alias("e"), F.length("name_nfc").alias("n"), F.lower("name_nfc").alias("f"), "name_nfc", "name_display")).alias("b")
    out = normal.groupBy("name_ascii_key", "name_type").agg(
        best, _piped("country_iso2").alias("countries"), _piped("language_tag").alias("languages"), _piped("source").alias("sources"), _piped("source_id").alias("source_ids"),
        F.sum("evidence_count").alias("total_evidence_count"), F.count("*").alias("occurrence_count"), F.max("fetched_at").alias("last_seen_at"))
    return out.select("b.name_display", "b.name_nfc", "name_ascii_key", "name_type", "countries", "languages", "sources", "source_ids", "total_evidence_count", "occurrence_count", "last_seen_at")


def unique_names(lexicon_rows: DataFrame) -> DataFrame:
    return lexicon_rows.select(F.col("name_nfc").alias("name"), "name_type").distinct()


def groups_table(spark, groups: dict[str, list[list[str]]]) -> DataFrame:
    """Published groups as rows (file, canonical, variant, key), the canonical form included."""
    key = lambda s: "".join(c for c in similarity.strip_marks(s.casefold()) if c.isalnum())
    rows = [(file, g[0], v, key(v)) for file, found in groups.items() for g in found for v in g]
    return spark.createDataFrame(rows, "file string, canonical string, variant string, key string")


def candidates(normal: DataFrame, groups: DataFrame, near: float = 0.72) -> DataFrame:
    """Spelling variants to review: other forms of one key, and near misses of a canonical name.

    ``groups`` is a dimension (file, canonical, variant, key). Near misses compare a name only with
    canonical names that share its first letter or its length class within two (ratio 0.72 needs both
    lengths within a factor of 1.8), never with all of them.
    """
    known = groups.groupBy("key").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals"))
    files = groups.groupBy("canonical").agg(F.min("file").alias("file"))
    pairs = groups.select("canonical", "variant").distinct()
    forms = normal.groupBy("name_ascii_key", "name_type", "name_nfc").agg(F.sum("evidence_count").alias("n"))
    cluster = ["name_ascii_key", "name_type"]
    facts = normal.groupBy(*cluster).agg(
        F.sum("evidence_count").alias("total"), F.count("*").alias("records"), F.count_distinct("name_nfc").alias("forms"), F.array_sort(F.collect_set("country_iso2")).alias("countries"), F.array_sort(F.collect_set("language_tag")).alias("languages"),
        _piped("source").alias("source"), _piped("source_license").alias("source_license"), F.array_sort(F.collect_set(F.when(F.col("source") == "wikidata", F.col("source_id")))).alias("wikidata_qids"))
    top = forms.groupBy(*cluster).agg(F.min_by("name_nfc", F.struct((-F.col("n")).alias("n"), "name_nfc")).alias("top"))
    base = facts.join(top, cluster).join(known, F.col("name_ascii_key") == F.col("key"), "left").where("forms >= 2 or key is not null")
    base = base.withColumn("canonical", F.coalesce(F.col("canonicals")[0], "top")).withColumn("conflict_flag", F.coalesce(F.size("canonicals") > 1, F.lit(False)))
    rows = base.join(forms, cluster).where("name_nfc <> canonical").withColumnRenamed("name_nfc", "variant")
    rows = rows.join(pairs, ["canonical", "variant"], "left_anti").join(files, "canonical", "left")
    alike = similarity.paired(lambda a, b: similarity.matching_blocks(*(normal_form(x)["name_ascii_key"] for x in (a, b))))(F.col("canonical"), F.col("variant"))
    score = F.expr("greatest(0D, least(0.99D, round(0.5 * _alike + 0.3 * least(1D, ln(1 + total) / 4) + 0.2 * least(1D, ln(1 + n) / 3) - if(conflict_flag, 0.2, 0), 4)))")
    west, east = (f"arrays_overlap(countries, array({', '.join(map(repr, c))}))" for c in (WEST, EAST))
    tradition = F.expr(f"coalesce(file, case when {west} and not {east} then 'west_african' when {east} and not {west} then 'east_african' else 'cross_linguistic' end)")
    rows = rows.withColumn("_alike", alike).withColumn("confidence", score).withColumn("suggested_tradition", tradition)
    rows = rows.withColumn("evidence_summary", F.expr("concat('variant_count=', n, '; total_records=', records, '; countries=', array_join(countries, ','), '; sources=', replace(source, '|', ','))"))

    # near misses: names whose key no group has
    loose = normal.join(known, normal["name_ascii_key"] == known["key"], "left_anti")
    loose_key = [F.col("name_nfc").alias("variant"), "name_type"]
    single = loose.groupBy(*loose_key).agg(F.min("name_ascii_key").alias("name_ascii_key"), F.count("*").alias("records"), F.array_sort(F.collect_set("country_iso2")).alias("countries"), F.array_sort(F.collect_set("language_tag")).alias("languages"), _piped("source").alias("source"), _piped("source_license").alias("source_license"), F.array_sort(F.collect_set(F.when(F.col("source") == "wikidata", F.col("source_id")))).alias("wikidata_qids"))
    heads = groups.where("canonical = variant").select("canonical", "key", "file").distinct()
    span = lambda c: F.expr(f"sequence(cast(floor(char_length({c}) * 0.56) as int), cast(ceil(char_length({c}) * 1.79) as int))")
    met = single.withColumn("size", F.explode(span("name_ascii_key"))).join(heads.withColumn("size", F.length("key")), "size")
    met = met.withColumn("ratio", similarity.paired(similarity.matching_blocks)(F.col("name_ascii_key"), F.col("key"))).where(F.col("ratio") >= near)
    best = met.groupBy("variant", "name_type").agg(F.max_by(F.struct("canonical", "file", "ratio", "records", "countries", "languages", "source", "source_license", "wikidata_qids"), F.struct("ratio", "canonical")).alias("b")).select("variant", "name_type", "b.*")
    best = best.where("variant <> canonical").join(pairs, ["canonical", "variant"], "left_anti")
    best = best.join(rows.select("canonical", "variant", "name_type"), ["canonical", "variant", "name_type"], "left_anti")
    best = best.withColumn("confidence", F.expr("greatest(0.7D, round(ratio * 0.95, 4))")).withColumn("suggested_tradition", F.coalesce("file", F.lit("cross_linguistic"))).withColumn("conflict_flag", F.lit(False))
    best = best.withColumn("evidence_summary", F.expr("concat('similarity_bootstrap=', format_number(ratio, '0.0000'), '; records=', records)"))
    cols = ["canonical", "variant", "name_type", "suggested_tradition", "confidence", "evidence_summary", "wikidata_qids", "countries", "languages", "source", "source_license", "conflict_flag"]
    both = rows.select(*cols).unionByName(best.select(*cols))
    return both.withColumn("status", F.lit("pending")).withColumn("candidate_id", F.expr("concat('cand_', left(sha1(concat_ws('|', canonical, variant, name_type)), 16))"))


def enriched(published: DataFrame, registry: DataFrame) -> DataFrame:
    """Published rows with the provenance of approved candidates of the same pair."""
    lists = ["wikidata_qids", "countries", "languages"]
    flat = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(c, lambda x: x != ""))))), "|").alias(c)
    known = registry.groupBy("canonical", "variant").agg(_piped("source").alias("source"), *(flat(c) for c in lists), F.max("confidence").alias("confidence"), F.max("applied_at").alias("last_seen_at"))
    out = published.join(known, ["canonical", "variant"], "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("canonical", "variant", "tradition", "file", empty("source"), F.coalesce("wikidata_qids", F.lit("")).alias("source_ids"), empty("countries"), empty("languages"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), empty("last_seen_at"))


def apply_approved(groups: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Group rows (file, canonical, variant) after the approved candidates; one without provenance is an error.

    A known canonical stays in its file; a new one goes to the suggested file if it exists, else to cross_linguistic.
    """
    ok = "if(coalesce(source, '') = '' or coalesce(source_license, '') = '', raise_error(concat('approved candidate ', candidate_id, ' has no provenance')), true)"
    approved = reviewed.where("status = 'approved'").where(F.expr(ok)).select("canonical", "variant", "suggested_tradition")
    home = groups.groupBy("canonical").agg(F.min("file").alias("home"))
    files = groups.select(F.col("file").alias("suggested_tradition"), F.lit(True).alias("there")).distinct()
    placed = approved.join(home, "canonical", "left").join(files, "suggested_tradition", "left")
    file = F.coalesce("home", F.when(F.col("there"), F.col("suggested_tradition")), F.lit("cross_linguistic"))
    new = placed.select(file.alias("file"), "canonical", F.explode(F.array("canonical", "variant")).alias("variant"))
    return groups.select("file", "canonical", "variant").unionByName(new).distinct()


def registry(existing: DataFrame, approved: DataFrame, applied_at: str) -> DataFrame:
    """Registry rows by candidate_id; newly approved ones replace older ones."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(approved.where("status = 'approved'").withColumn("applied_at", F.lit(applied_at)).withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("candidate_id").orderBy(F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def bundle_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "rejected")), F.count_if("conflict_flag").alias("conflicts"))


def write_bundle(rows: DataFrame, path: str) -> None:
    """All candidates, and a folder for each status, as CSV."""
    flat = rows.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])
    flat.orderBy("candidate_id").write.mode("overwrite").option("header", True).csv(f"{path}/review_candidates")
    flat.write.mode("overwrite").partitionBy("status").option("header", True).csv(f"{path}/by_status")


def stats(published: DataFrame, enriched_rows: DataFrame) -> DataFrame:
    a = published.agg(F.count("*").alias("legacy_rows"), F.count_distinct("canonical").alias("legacy_groups"), F.array_sort(F.collect_set("file")).alias("legacy_files"))
    b = enriched_rows.agg(F.count("*").alias("enriched_rows"), F.count_if((F.col("source") != "") | (F.col("source_ids") != "")).alias("rows_with_provenance"))
    return a.join(b)  # one row each
