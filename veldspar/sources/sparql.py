"""A paged SPARQL endpoint as a Spark data source: one partition for each country, kind of name and way to ask.

Rows are fetched on the executors by the caller's function (query text -> JSON text), so the source
works with any client and, in tests, without a network. A page shorter than the limit ends a partition;
failures are tried again with doubled waits.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "qid string, name string, language string, name_type string, country_iso2 string, mode string"
#: Properties that lead from a person to a name, and the classes of names.
PROPERTIES = {"given": "P735", "family": "P734"}
CLASSES = {"given": "Q202444", "family": "Q101352"}


def question(country_qid: str, name_type: str, mode: str, limit: int, offset: int, languages: tuple[str, ...]) -> str:
    """The query of one page: names of people of a country, or names that belong to it themselves."""
    if mode == "person":
        body = f"?p wdt:P31 wd:Q5 ; wdt:P27 wd:{country_qid} ; wdt:{PROPERTIES[name_type]} ?n ."
    else:
        body = f"?n wdt:P31/wdt:P279* wd:{CLASSES[name_type]} ; wdt:P17|wdt:P495 wd:{country_qid} ."
    wanted = ", ".join(f'"{tag}"' for tag in languages)
    return f"SELECT DISTINCT ?n ?label WHERE {{ {body} {{ ?n rdfs:label ?label }} UNION {{ ?n skos:altLabel ?label }} FILTER(LANG(?label) IN ({wanted})) }} ORDER BY ?n ?label LIMIT {limit} OFFSET {offset}"


def rows_of(answer: str) -> list[tuple[str, str, str]]:
    """(id, name, language) of one page, each once."""
    out: dict[tuple[str, str, str], tuple[str, str, str]] = {}
    for b in json.loads(answer)["results"]["bindings"]:
        qid, name, lang = b["n"]["value"].rsplit("/", 1)[-1], b["label"]["value"], b["label"].get("xml:lang", "und")
        out.setdefault((qid, name.casefold(), lang), (qid, name, lang))
    return list(out.values())


@dataclass
class Part(InputPartition):
    country: str
    qid: str
    name_type: str
    mode: str


class _Reader(DataSourceReader):
    def __init__(self, parts: list[Part], fetch: Callable[[str], str], limit: int, pages: int, tries: int, wait: float, languages: tuple[str, ...]) -> None:
        self.parts, self.fetch, self.limit, self.pages, self.tries, self.wait, self.languages = parts, fetch, limit, pages, tries, wait, languages

    def partitions(self) -> list[Part]:
        return self.parts

    def _page(self, part: Part, number: int) -> str:
        text = question(part.qid, part.name_type, part.mode, self.limit, number * self.limit, self.languages)
        for attempt in range(self.tries):
            try:
                return self.fetch(text)
            except OSError:
                if attempt + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**attempt)
        raise ValueError("tries must be positive")

    def read(self, part: Part) -> Iterator[tuple]:
        for number in range(self.pages):
            answer = self._page(part, number)
            for qid, name, language in rows_of(answer):
                yield qid, name, language, part.name_type, part.country, part.mode
            if len(json.loads(answer)["results"]["bindings"]) < self.limit:
                return


def names(spark: SparkSession, countries: dict[str, str], fetch: Callable[[str], str], limit: int = 5000, pages: int = 12, tries: int = 4, wait: float = 2.0, languages: tuple[str, ...] = ("en", "fr", "pt", "ar", "sw", "am", "ha", "yo", "ig", "so"), modes: tuple[str, ...] = ("person", "entity")) -> DataFrame:
    """Names of countries (ISO code -> entity id) from an endpoint."""
    parts = [Part(iso, qid, kind, mode) for iso, qid in countries.items() for kind in PROPERTIES for mode in modes]

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "sparql_names"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> _Reader:
            return _Reader(parts, fetch, limit, pages, tries, wait, languages)

    spark.dataSource.register(Source)
    return spark.read.format("sparql_names").load()
