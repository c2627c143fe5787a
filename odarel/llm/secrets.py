"""Secret scans with an incremental ledger of blobs.

Every version of a file is addressed by the SHA-256 of its content. Only pairs
of blob and rule version that the ledger lacks are scanned; findings are then
joined back to all paths that hold the blob. A rule's version is a hash of what it
says, so that changing one rule scans nothing anew for the others.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odarel.llm.shared import materialize

SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
#: A ledger's rows: the rule versions that a blob was scanned with, and what they found.
LEDGER = "blob binary, scanned array<string>, spans array<struct<rule:string,start:int,end:int>>"
FOUND = "array<struct<rule:string,start:int,end:int>>"
#: Matches whose places are added up in one go.
BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    ``hint`` is a pattern found in every text that has such a match.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None

    def named(self, version: str) -> str:
        """The rule's version: its kind and a hash of what decides its matches."""
        said = "\n".join((version, self.pattern, str(self.group), str(self.least)))
        return f"{self.kind}-{hashlib.sha256(said.encode()).hexdigest()[:16]}"


#: A run of hex digits or of an access key ends at the same place wherever its match
#: begins, so that asking for the length in the pattern drops the same matches as
#: asking for it afterwards. The value of an assignment is another matter: a short
#: one still uses up its characters.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
VERSION = "base-1"


def rule_spans(text: Column, rule: Rule, name: str) -> Column:
    """Places of the rule's matches: code points, end exclusive, by start.

    The pieces between matches and the matches themselves alternate, so that adding up
    their lengths gives the places: first inside blocks of matches, then over the blocks, so that
    no long array is copied once per match.
    """
    none = F.array().cast(FOUND)
    pattern = F.lit(rule.pattern)
    pieces = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    steps = F.arrays_zip(
        F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), F.char_length).alias("gap"),
        F.transform(hits, F.char_length).alias("hit"),
        F.transform(values, F.char_length).alias("value"),
    )

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        end = begin + x["hit"]
        span = F.struct(F.lit(name).alias("rule"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["value"] >= rule.least, F.concat(s["found"], F.array(span))).otherwise(s["found"]).cast(FOUND).alias("found"))

    def inside(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("found")), step)

    def shifted(found: Column, by: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["rule"].alias("rule"), (x["start"] + by).alias("start"), (x["end"] + by).alias("end")))

    def over(s: Column, block: Column) -> Column:
        return F.struct((s["at"] + block["at"]).alias("at"), F.concat(s["parts"], F.array(shifted(block["found"], s["at"]))).cast(f"array<{FOUND}>").alias("parts"))

    def joined(all_steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_steps) - 1, F.lit(0)) / BLOCK).cast("int")), lambda i: inside(F.slice(all_steps, i * BLOCK + 1, F.lit(BLOCK))))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FOUND}>").alias("parts")), over)["parts"])

    # bound as a variable, so that the text is searched once and not for each block
    return F.when(text.rlike(rule.hint or rule.pattern), F.get(F.transform(F.array(steps), joined), F.lit(0))).otherwise(none)


def blob_of(text: Column) -> Column:
    """Content address; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Ledger:
    """A ledger in a folder that all executors share: Parquet that only grows, a part per scan.

    A part is there as a whole or not at all. A pair that two scans at a time both found missing is there twice and counts once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def extend(self, versions: DataFrame, *, text: str = "text", rules=RULES, version: str = VERSION) -> None:
        """Scan what isn't there yet, and add it."""
        scan_unseen(versions, self.read(), text=text, rules=rules, version=version).write.mode("append").parquet(self.path)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, *, text: str = "text", rules=RULES, version: str = VERSION) -> DataFrame:
    """New ledger rows: one for each blob with the rule versions that it was not yet scanned with.

    Copies meet on the map side first, so that a blob which fills a third of the rows
    reaches its task once per map task.
    """
    names = [r.named(version) for r in rules]
    blobs = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.any_value("text").alias("text"))
    todo = F.array(*map(F.lit, names)).cast("array<string>")
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        todo = F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))
    unseen = blobs.select("blob", "text", todo.alias("scanned")).filter(F.size("scanned") > 0)
    found = [F.when(F.array_contains("scanned", n), rule_spans(F.col("text"), r, n)).otherwise(F.array().cast(FOUND)) for r, n in zip(rules, names, strict=True)]
    return unseen.select("blob", "scanned", F.concat(*found).cast(FOUND).alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, *, key: str = "doc_id", text: str = "text", rules=RULES, version: str = VERSION) -> DataFrame:
    """``key``, ``blob`` and ``spans`` by start, then in the rules' order, for every row of ``versions``, from the ledger alone."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.named(version), i)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.named(version), r.kind)])
    known = ledger.filter(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ours = F.filter("spans", lambda s: F.element_at(rank, s["rule"]).isNotNull())
    spans = F.transform(ours, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["rule"]).alias("rank"), F.element_at(kind, s["rule"]).alias("kind"), s["end"].alias("end")))

    def once(a: Column) -> Column:
        return F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))

    # sorted first: a pair scanned twice has its spans side by side
    spans = F.get(F.transform(F.array(F.sort_array(spans).cast(SPANS)), once), F.lit(0))
    known = materialize(known.select("blob", spans.alias("spans")).filter(F.size("spans") > 0), "secrets-known")
    found = versions.select(F.col(key).alias(key), blob_of(F.col(text)).alias("blob")).join(known, "blob", "left")
    return found.select(key, "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def find_secrets(versions: DataFrame, ledger: DataFrame | None = None, *, key: str = "doc_id", text: str = "text", rules=RULES, version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``versions``, and the ledger's new rows, already written.

    The first frame has ``key``, ``blob`` and ``spans``, a row per row, with an empty
    array where nothing was found. Null and empty texts are the same, empty, blob.
    Repeated rows and null keys keep their rows. An empty table gives empty
    frames. Other columns are ignored. ``Ledger`` keeps the new rows from one call to the next.
    """
    fresh = materialize(scan_unseen(versions, ledger, text=text, rules=rules, version=version), "secrets-ledger")
    known = fresh if ledger is None else ledger.union(fresh)
    return findings(versions, known, key=key, text=text, rules=rules, version=version), fresh
