"""Readers and writers: documents, tables of records, dimensions."""

from __future__ import annotations

import html.parser
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veldspar.functions import similarity
from veldspar.operators.policy import Statute

PLAIN = ("txt", "text", "log", "md", "rst", "csv", "tsv", "json", "jsonl")
BINARY = ("pdf", "docx", "png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """source_file and text of plain files, whole and with normal white space; CSV and JSON stay raw."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))
    kind = F.lower(F.regexp_extract("source_file", r"\.([A-Za-z0-9]+)$", 1))
    checked = F.when(~kind.isin(*PLAIN), F.raise_error(F.format_string("%s is no plain-text file", "source_file"))).otherwise(F.col("source_file"))
    return df.select(checked.alias("source_file"), F.expr(similarity.whitespace_sql("text")).alias("text"))


def binaries(spark: SparkSession, path: str, extract: Callable[[str, bytes], tuple[str, int]]) -> DataFrame:
    """source_file, text and num_pages of PDF, DOCX or image files, by the caller's extractor.

    ``extract(path, content)`` runs on the executors; the parsers it needs are installed there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(p, *extract(p, c)) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["source_file", "text", "num_pages"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "source_file string, text string, num_pages int")


def fetched(urls: DataFrame, fetch: Callable[[str], str], column: str = "url") -> DataFrame:
    """Pages of a column of addresses through the caller's ``fetch``; private hosts and other schemes are refused before."""

    @F.arrow_udf("string")
    def run(found: pa.Array) -> pa.Array:
        return pa.array([None if u is None else fetch(u) for u in found.to_pylist()], pa.string())

    ok = F.expr(f"`{column}` rlike '^https?://'") & ~private_host(F.regexp_extract(column, r"^https?://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    checked = F.when(ok, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("refused: "), F.col(column))))
    return urls.withColumn("html", run(checked))


def private_host(host: Column) -> Column:
    """Whether a literal address is private, loopback, link-local, multicast, reserved or unspecified; localhost is."""

    @F.arrow_udf("boolean")
    def run(hosts: pa.Array) -> pa.Array:
        import ipaddress

        def bad(h: str | None) -> bool:
            h = (h or "").strip("[]").lower()
            if h in ("", "localhost"):
                return True
            try:
                a = ipaddress.ip_address(h)
            except ValueError:
                return False
            return a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified

        return pa.array([bad(h) for h in hosts.to_pylist()], pa.bool_())

    return run(host)


_SKIPPED = {"script", "style", "noscript", "template"}
_BLOCKS = {"p", "div", "br", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "section", "article", "aside", "header", "footer", "nav", "main"}


class _Text(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.skip = 0

    def _edge(self, tag: str, step: int) -> None:
        if tag in _SKIPPED:
            self.skip = max(0, self.skip + step)
        elif tag in _BLOCKS and not self.skip:
            self.out.append("\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._edge(tag, 1)

    def handle_endtag(self, tag: str) -> None:
        self._edge(tag, -1)

    def handle_data(self, data: str) -> None:
        if not self.skip and data.strip():
            self.out.append(data)


def plain_text(page: str | None) -> str | None:
    """Readable text of a page: a line for each block, blanks collapsed, empty lines dropped."""
    if page is None:
        return None
    reader = _Text()
    reader.feed(page)
    reader.close()
    return "\n".join(line for line in (" ".join(part.split()) for part in "".join(reader.out).split("\n")) if line)


def html_text(column: Column) -> Column:
    return similarity.mapped(plain_text)(column)


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header as texts: "key: value | key: value", empty values and rows left out."""
    return as_texts(spark.read.option("header", True).csv(path))


def as_texts(rows: DataFrame) -> DataFrame:
    parts = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in rows.columns]
    return rows.select(F.concat_ws(" | ", *parts).alias("text")).where("text <> ''")


def records(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV (header) or JSON-lines rows under an explicit schema; a missing path is an empty table."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not spark._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().globPath(hadoop).nonEmpty():
        return spark.createDataFrame([], kind)
    reader = spark.read.schema(kind)
    return reader.option("header", True).csv(path) if path.rstrip("/*").endswith("csv") else reader.json(path)


def curated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of every CSV under a folder but the ``sample_`` files, without the curation-only columns."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    kept = df.where(~F.col("_metadata.file_name").startswith("sample_"))
    return kept.drop("canonical", "suggested_tradition", "reviewer_notes")


def _yaml(path: str) -> list[tuple[str, dict]]:
    import yaml

    files = [path] if path.endswith((".yaml", ".yml")) else sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith((".yaml", ".yml")))
    out = []
    for f in files:
        with open(f, encoding="utf-8") as handle:
            out.append((os.path.splitext(os.path.basename(f))[0], yaml.safe_load(handle)))
    return out


def statutes(path: str) -> dict[str, Statute]:
    """Statutes of a YAML file or folder on the driver; what is malformed is an error here, not later."""
    out = {}
    for name, raw in _yaml(path):
        missing = {"statute_id", "jurisdiction", "version", "policy_mappings"} - set(raw if isinstance(raw, dict) else ())
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
        maps = {c: (m.get("action", raw.get("default_action", "mask")), m.get("tier") or "moderate", m.get("statute_reference"), m.get("rationale")) for c, m in (raw["policy_mappings"] or {}).items()}
        out[raw["statute_id"]] = Statute(raw["statute_id"], raw["jurisdiction"], str(raw["version"]), raw.get("default_statute_reference", ""), maps, raw.get("default_action", "mask"))
    return out


def name_groups(path: str) -> dict[str, list[list[str]]]:
    """Groups of equivalent names by file: the canonical form first."""
    return {name: [[str(g["canonical"]), *map(str, g.get("variants") or [])] for g in (raw or {}).get("groups", []) if g.get("canonical")] for name, raw in _yaml(path)}


def gazetteer(spark: SparkSession, path: str | None = None) -> DataFrame:
    """name, country, country_name, region, lat, lng, aliases: a table of the caller's, or the built-in one."""
    from veldspar.data import places

    kind = "name string, country string, country_name string, region string, lat double, lng double, aliases array<string>"
    if path is None:
        return spark.createDataFrame(places.cities(), kind)
    return spark.read.schema(kind).json(path)


def countries(spark: SparkSession, path: str) -> DataFrame:
    """Country metadata (code, name, region, calling code, currencies, languages, borders) from a JSON-lines file."""
    return spark.read.schema("code string, name string, region string, calling_code string, currencies array<string>, languages map<string,string>, borders array<string>").json(path)


def name_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Distinct tokens of two letters or more of a JSON-lines lexicon, without marks and in lower case."""
    df = spark.read.schema("name string, name_nfc string, name_display string").json(path).select(F.coalesce("name", "name_nfc", "name_display").alias("n"))
    folded = similarity.mapped(lambda n: similarity.strip_marks(n).lower())(F.col("n"))
    return df.select(F.explode(F.split(folded, r"\s+")).alias("token")).where("char_length(token) >= 2").distinct()


def publish(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """One file of a small published table."""
    writer = rows.coalesce(1).write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "jsonl": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()


def places(spark: SparkSession, path: str) -> DataFrame:
    """Place records (id, name, address, kind, anchor, distance_m, lat, lon, note) of JSON files, several lines a record allowed."""
    return spark.read.schema("id string, name string, address string, kind string, anchor string, distance_m int, lat double, lon double, note string").option("multiLine", True).json(path)


def export(results: DataFrame, path: str, kind: str = "json") -> None:
    """Nested results as JSON lines, or their entities as a six-column CSV."""
    if kind == "json":
        results.write.mode("overwrite").json(path)
    elif kind == "csv":
        rows = results.select(F.explode("entities").alias("e")).select("e.text", "e.entity_type", "e.confidence", "e.start", "e.end", "e.source")
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"json or csv, not {kind!r}")
