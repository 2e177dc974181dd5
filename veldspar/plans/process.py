"""Documents in, findings, redacted text and policy outcomes out: one projection from end to end."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.data import statutes as data
from veldspar.operators import detectors, policy


@dataclass(frozen=True)
class Options:
    """What a run does; ``options.but(...)`` gives a changed copy."""

    jurisdiction: str | None = None
    statute: str | None = None
    packages: tuple[str, ...] | None = None
    salt: str = ""
    overlap: str = "resolve"
    repeats: bool = False

    def but(self, **changes) -> Options:
        unknown = set(changes) - set(self.__dataclass_fields__)
        if unknown:
            raise TypeError(f"no such option: {sorted(unknown)}")
        return replace(self, **changes)

    @property
    def statute_id(self) -> str | None:
        return self.statute or data.FOR_JURISDICTION.get((self.jurisdiction or "").upper())

    def describe(self) -> dict:
        return {"jurisdiction": self.jurisdiction, "statute": self.statute_id, "detectors": list(self.packages or detectors.default_packages(self.jurisdiction)), "overlap": self.overlap}


def process(docs: DataFrame, options: Options = Options(), text: str = "text", statute: policy.Statute | None = None) -> DataFrame:
    """``docs`` and document_hash, detections, redacted_text, policy_outcomes, jurisdiction, statute_id, statute_version.

    Works on streams as on tables: no step keeps state. Without a statute the text stays as it is and no
    outcome follows. Null text hashes as the empty text.
    """
    df = docs.withColumn("document_hash", F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))
    df = detectors.detect(df, text, "detections", options.jurisdiction, list(options.packages) if options.packages else None, repeats=options.repeats)
    chosen = statute or (policy.load(options.statute_id) if options.statute_id else None)
    if chosen is None:
        df = df.withColumn("redacted_text", F.col(text)).withColumn("policy_outcomes", F.expr(f"cast(array() as array<struct<{policy.OUTCOME}>>)"))
    else:
        df = policy.enrich(policy.apply(df, chosen, text, "detections", options.salt, options.overlap), chosen)
    lit = lambda v: F.lit(v).cast("string")
    return df.withColumns({"jurisdiction": lit(options.jurisdiction), "statute_id": lit(chosen.statute_id if chosen else None), "statute_version": lit(chosen.version if chosen else None)})


def outcomes(processed: DataFrame, *keys: str) -> DataFrame:
    """One row a policy outcome."""
    return processed.select(*keys, "document_hash", F.explode("policy_outcomes").alias("o")).select(*keys, "document_hash", "o.*")
