"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. A ledger holds the
pairs of blob and rule version that have been scanned; a scan works only on pairs it has not
seen, once for each distinct blob however many paths hold it, and joins the findings back to
all paths. Findings are spans in code points, end exclusive.

A rule's matches are the leftmost ones that do not overlap; a match failing the rule's least
lengths is dropped. Splitting a text at its matches gives the text between them, so places
follow from lengths alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.llm.common import settings, stage


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the least code points of the match and of one group."""

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0
    least_group: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}/{self.version}"


# The base kinds in their order. Runs are taken whole, so a least length in the
# pattern of the last two finds the same as dropping short runs afterwards.
RULES = (
    Rule(
        "assign",
        1,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least_group=6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", least=20),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}", least=24),
)

SPAN = "struct<start: long, end: long, rank: int, kind: string>"
PIECES = "array<struct<gap: long, size: long, fits: boolean>>"
BLOCK = 1024  # code points of a block in which redaction looks up places


def pieces(text: Column, rule: Rule) -> Column:
    """What one rule cuts a text into: the text before each match, the match, and whether it is long enough.

    The last piece has no match. A text without any match gives an empty array; it is only
    searched, not cut.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    cut = F.transform(
        F.arrays_zip(between.alias("gap"), F.transform(matches, F.length).alias("size"), F.transform(groups, F.length).alias("own")),
        lambda p: F.struct(
            p["gap"].cast("long").alias("gap"),
            p["size"].cast("long").alias("size"),
            ((p["size"] >= rule.least) & (p["own"] >= rule.least_group)).alias("fits"),
        ),
    )
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), cut).otherwise(F.array().cast(PIECES))


def placed(cells: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, rule, found`` of rows ``blob, rule, pieces``; places are running sums of lengths.

    Every piece is a row for a while, so a text of very many findings costs what its pieces do.
    Rows lie by blob already, and neither the window nor the grouping moves them.
    """
    rows = cells.select("blob", "rule", F.posexplode_outer("pieces").alias("_pos", "_piece")).select("blob", "rule", "_pos", "_piece.*")
    before = Window.partitionBy("blob", "rule").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(before))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "end")
    found = ends.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(F.when(F.col("fits"), span))).alias("found"))
    rank = F.element_at(F.create_map(*[F.lit(v) for i, r in enumerate(rules) for v in (r.name, i)]), F.col("rule"))
    kind = F.element_at(F.create_map(*[F.lit(v) for r in rules for v in (r.name, r.kind)]), F.col("rule"))
    named = found.select("blob", "rule", "found", rank.alias("_rank"), kind.alias("_kind"))
    whole = F.transform("found", lambda s: F.struct(s["start"], s["end"], F.col("_rank").alias("rank"), F.col("_kind").alias("kind")))
    return named.select("blob", "rule", whole.cast(f"array<{SPAN}>").alias("found"))


def blob_id(text: Column) -> Column:
    """The address of a content: its SHA-256; a null content is the empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def empty_ledger(spark) -> DataFrame:
    """A ledger that has seen nothing."""
    columns = (F.lit("").alias("blob"), F.lit("").alias("rule"), F.array().cast(f"array<{SPAN}>").alias("found"))
    return spark.range(0).select(*columns)


def scan(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    key: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Scan every version of every path: ``(findings, additions)``.

    ``findings`` has a row for each row of ``versions``: ``key, blob, spans`` with the spans of
    all rules by start, then rule order. ``additions`` are the new ledger rows ``blob, rule,
    found``, to be appended to the ledger's table; together with ``ledger`` they hold every
    pair of the given blobs and rules. Null texts are empty and hold nothing; empty tables,
    repeated rows, null keys and other columns change nothing. A text may be very long and hold
    very many findings: the work grows with its length, and its findings make one array.
    """
    spark = settings(versions.sparkSession)
    paths = stage(versions.select(F.col(key).alias("_path"), blob_id(F.col(text)).alias("blob")), "blob-paths")
    names = [r.name for r in rules]
    seen = None
    if ledger is not None:
        seen = ledger.where(F.col("rule").isin(names)).groupBy("blob").agg(F.collect_set("rule").alias("_done"))

    # One row of each blob, texts combined within each task before they are dealt out.
    blobs = (
        versions.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .groupBy("blob")
        .agg(F.first("_text").alias("_text"))
    )
    if seen is not None:
        blobs = blobs.join(seen, "blob", "left")
    done = F.coalesce(F.col("_done"), F.array().cast("array<string>")) if seen is not None else F.array().cast("array<string>")
    cells = [
        F.when(
            ~F.array_contains(done, r.name),
            F.struct(F.lit(r.name).alias("rule"), pieces(F.col("_text"), r).alias("pieces")),
        )
        for r in rules
    ]
    scanned = blobs.select("blob", F.array_compact(F.array(*cells)).alias("_cells")).select("blob", F.inline("_cells"))
    additions = stage(placed(scanned, rules), "blob-ledger")

    every = additions
    if ledger is not None:
        every = additions.unionByName(ledger.where(F.col("rule").isin(names)).select("blob", "rule", "found"))
    findings = paths.join(by_blob(every), "blob", "left").select(
        F.col("_path").alias(key), "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans")
    )
    return findings, additions


def by_blob(ledger: DataFrame) -> DataFrame:
    """``blob, spans`` of the blobs of a ledger in which something was found; at most a row a rule is gathered."""
    found = ledger.where(F.size("found") > 0).groupBy("blob")
    return found.agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("spans"))


def redacted(
    docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All rows of ``docs`` with every span found in their texts replaced; null texts stay null.

    Repeated rows, null keys and other columns stay as they are; an empty table gives an empty one.
    """
    names = [r.name for r in rules]
    _, additions = scan(docs, ledger, rules, key, text)
    every = additions if ledger is None else additions.unionByName(ledger.where(F.col("rule").isin(names)).select("blob", "rule", "found"))
    found = cuts(every).select(F.col("blob").alias("_blob"), "_cuts", "_last")
    marked = docs.withColumn("_blob", blob_id(F.col(text))).join(found, "_blob", "left")
    clean = F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(redact(F.col(text), F.col("_cuts"), F.col("_last")))
    return marked.withColumn(text, clean).select(*docs.columns)


def cuts(ledger: DataFrame) -> DataFrame:
    """``blob, _cuts, _last``: the kept stretches ``from, to`` before each run of overlapping spans, and where the last run ends."""
    rows = ledger.where(F.size("found") > 0).select("blob", F.inline("found"))
    earlier = Window.partitionBy("blob").orderBy("start", "end", "rank").rowsBetween(Window.unboundedPreceding, -1)
    reached = rows.withColumn("_at", F.coalesce(F.max("end").over(earlier), F.lit(0).cast("long")))
    stretch = F.struct(F.col("_at").alias("from"), F.col("start").alias("to"))
    fresh = F.when(F.col("start") >= F.col("_at"), stretch)
    return reached.groupBy("blob").agg(F.array_sort(F.collect_list(fresh)).alias("_cuts"), F.max("end").alias("_last"))


def joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, cuts: Column, last: Column, mark: str = "[REDACTED]") -> Column:
    """The stretches ``cuts`` of a text, a mark after each, and what follows ``last``.

    The text is cut into blocks once, and each stretch is read from the blocks it touches.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def between(held: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK)
        near = F.slice(held, (first + 1).cast("int"), (F.ceil(end / BLOCK) - first).cast("int"))
        return F.substring(F.array_join(near, ""), (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))

    def build(held: Column) -> Column:
        kept = F.transform(cuts, lambda c: F.concat(between(held, c["from"], c["to"]), F.lit(mark)))
        rest = F.array_join(F.slice(held, (F.floor(last / BLOCK) + 1).cast("int"), F.size(held)), "")
        tail = F.substring(rest, (last - F.floor(last / BLOCK) * BLOCK + 1).cast("int"), F.lit(2**31 - 1))
        return F.concat(F.array_join(kept, ""), tail)

    # A one-element array binds the blocks, so they are cut once and not for every stretch.
    return F.element_at(F.transform(F.array(blocks), build), 1)
