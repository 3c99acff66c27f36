"""Secret scans over a content-addressed ledger: each version of each text is scanned once per rule version, whatever paths it has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from foliometry.llm.tables import free_names, new_folder, read, stored

SPAN = "struct<start:bigint,end:bigint,first_byte:bigint,end_byte:bigint>"
FINDINGS = f"blob string, rule string, rule_version int, spans array<{SPAN}>"
MARK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`; those whose `group` has fewer than `least` characters are dropped."""

    name: str
    version: int
    pattern: str
    group: int
    least: int


#: Fixed kinds, in their order.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24),
)


def pieces_of(text: Column, rule: Rule) -> Column:
    """What lies between matches and the matches themselves, in turn, by their sizes in code points and bytes; empty where nothing matches."""
    between, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    telling = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    pieces = F.arrays_zip(between.alias("between"), matches.alias("match"), telling.alias("telling"))
    sizes = F.transform(
        F.filter(pieces, lambda p: p["match"].isNotNull()),
        lambda p: F.struct(
            F.length(p["between"]).alias("gap"), F.length(p["match"]).alias("size"), F.octet_length(p["between"]).alias("gap_bytes"), F.octet_length(p["match"]).alias("bytes"), (F.length(p["telling"]) >= rule.least).alias("kept")
        ),
    )
    return F.when(text.rlike(rule.pattern), sizes).otherwise(F.array().cast("array<struct<gap:int,size:int,gap_bytes:int,bytes:int,kept:boolean>>"))


def spans_of(pieces: DataFrame) -> DataFrame:
    """FINDINGS from (blob, rule, rule_version, pieces). Places are running sums over a text's pieces, so work is linear in their number; the rows
    of a blob lie in one partition already."""
    each = pieces.select("blob", "rule", "rule_version", F.posexplode_outer("pieces").alias("place", "piece"))
    upto = Window.partitionBy("blob", "rule").orderBy("place")
    end = F.sum(F.col("piece.gap").cast("bigint") + F.col("piece.size")).over(upto)
    end_byte = F.sum(F.col("piece.gap_bytes").cast("bigint") + F.col("piece.bytes")).over(upto)
    span = F.struct((end - F.col("piece.size")).alias("start"), end.alias("end"), (end_byte - F.col("piece.bytes")).alias("first_byte"), end_byte.alias("end_byte"))
    placed = each.select("blob", "rule", "rule_version", F.when(F.col("piece.kept"), span).alias("span"))
    return placed.groupBy("blob", "rule", "rule_version").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def versions_of(documents: DataFrame) -> DataFrame:
    """documents with the content address of each text (null: the empty text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.withColumn("text", text).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame | None:
    try:
        return spark.read.schema(FINDINGS).parquet(ledger)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def scan_unseen(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan the (blob, rule version) pairs that the ledger lacks, append them with their spans, and return the ledger's rows for these rules.

    versions: (blob, text). Every scanned pair is entered, with empty spans if nothing was found, so that it is never scanned again.
    """
    spark = versions.sparkSession
    known = ledger_rows(spark, ledger)
    texts = versions.select("blob", "text")
    rule_list = spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, rule_version int")
    if known is not None:
        done = known.join(F.broadcast(rule_list), ["rule", "rule_version"], "left_semi").groupBy("blob").agg(F.collect_set("rule").alias("done"))
        blobs = texts.dropDuplicates(["blob"]).join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
        blobs = blobs.where(F.size("done") < len(rules))
    else:
        blobs = texts.dropDuplicates(["blob"]).withColumn("done", F.array().cast("array<string>"))
    scans = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), F.when(~F.array_contains("done", r.name), pieces_of(F.col("text"), r)).alias("pieces"))
        for r in rules
    ]
    cut = blobs.select("blob", F.explode(F.array(*scans)).alias("scan")).select("blob", "scan.rule", "scan.rule_version", "scan.pieces").where("pieces is not null")
    spans_of(cut).write.mode("append").parquet(ledger)
    return ledger_rows(spark, ledger).join(F.broadcast(rule_list), ["rule", "rule_version"], "left_semi")


def findings_by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found): all spans of a blob as (start, kind number, kind, end, first byte, end byte), in order; only blobs with any. A pair that was entered twice counts once."""
    number = F.coalesce(*(F.when(F.col("rule") == r.name, F.lit(k)) for k, r in enumerate(rules)))
    some = findings.where(F.size("spans") > 0).select("blob", number.alias("kind_number"), F.col("rule").alias("kind"), F.explode("spans").alias("span"))
    return some.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct(F.col("span.start").alias("start"), "kind_number", "kind", F.col("span.end").alias("end"), "span.first_byte", "span.end_byte"))).alias("found"))


def scan(documents: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of documents with `blob` and `found`, the ordered spans of their text (empty where there are none).

    A null text is the empty text, which has no findings. Repeated rows and equal texts share one scan and get equal results; an empty table
    gives no rows; only doc_id and text are read, other columns are dropped.
    """
    versions = versions_of(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    by_blob = findings_by_blob(scan_unseen(versions, ledger, rules), rules)
    joined = versions.select("doc_id", "blob").join(by_blob, "blob", "left")
    shown = F.transform("found", lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind_number", "kind", "end"))))
    return joined.withColumn("found", F.coalesce(shown, F.array().cast("array<struct<start:bigint,kind_number:int,kind:string,end:bigint>>")))


def merged(by_blob: DataFrame) -> DataFrame:
    """(blob, cuts): the bytes that a blob's spans cover, (first_byte, end_byte), overlapping spans as one, in order."""
    spans = by_blob.select("blob", F.explode("found").alias("span")).select("blob", "span.first_byte", "span.end_byte")
    order = Window.partitionBy("blob").orderBy("first_byte", "end_byte")
    before = F.max("end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.when(before.isNull() | (before <= F.col("first_byte")), 1).otherwise(0)).withColumn("cut", F.sum("fresh").over(order))
    cuts = fresh.groupBy("blob", "cut").agg(F.struct(F.min("first_byte").alias("first_byte"), F.max("end_byte").alias("end_byte")).alias("bytes"))
    return cuts.groupBy("blob").agg(F.sort_array(F.collect_list("bytes")).alias("cuts"))


def redact(documents: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """documents with every span, overlapping ones as one, replaced by MARK, and n_chars, where there is one, counted anew; other rows stay as they are.

    All columns keep their names and values, whatever they are called. Null texts stay null, repeated rows are redacted each, an empty table gives
    no rows. Work is linear in a text's length and its number of spans.
    """
    blob, cuts = free_names(documents, "blob", "cuts")
    rows = documents.withColumn(blob, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    texts = rows.select(F.col(blob).alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    by_blob = merged(findings_by_blob(scan_unseen(texts, ledger, rules), rules))
    joined = rows.join(by_blob.select(F.col("blob").alias(blob), F.col("cuts").alias(cuts)), blob, "left")

    whole, found = F.col("text").cast("string").cast("binary"), F.col(cuts)
    since = lambda i: F.when(i > 0, F.element_at(found, i)["end_byte"]).otherwise(F.lit(0).cast("bigint"))
    part = lambda a, b: F.substring(whole, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    gaps = F.transform(found, lambda c, i: part(since(i), c["first_byte"]))
    tail = part(F.element_at(found, -1)["end_byte"], F.octet_length("text").cast("bigint"))
    cleaned = joined.withColumn("text", F.when(found.isNotNull(), F.concat(F.array_join(gaps, MARK), F.lit(MARK), tail)).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(found.isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType))
    return cleaned.select(*documents.columns)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries over one ledger: the documents of the sources whose name ends in an even digit, then all; scanned_now tells what the second had to scan."""
    documents, ledger = read(spark, sf_dir, "documents"), new_folder(spark, "secret-ledger")
    scan_unseen(versions_of(documents.where(F.col("source").rlike("[02468]$")).select("text")), ledger)
    seen = ledger_rows(spark, ledger).select("blob").distinct().withColumn("seen", F.lit(True))
    seen = stored(seen)
    found = scan(documents, ledger).join(seen, "blob", "left")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(r.name) for r in RULES), F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), F.col("seen").isNull().alias("scanned_now"))


OP8_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
    SELECT doc_id, 'assign' AS kind, 0 AS number, 6 AS least, string_split_regex(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS between,
        regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS whole,
        regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS telling FROM texts
    UNION ALL SELECT doc_id, 'access', 1, 20, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM texts
    UNION ALL SELECT doc_id, 'hex', 2, 24, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') FROM texts),
each AS (SELECT doc_id, kind, number, least, between, whole, telling, unnest(range(1, len(whole) + 1)) AS k FROM cut),
lengths AS (SELECT doc_id, kind, number, least, k, length(whole[k]) AS size, length(telling[k]) AS told, length(between[k]) AS gap FROM each),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY k) AS stop FROM lengths),
kept AS (SELECT doc_id, kind, number, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE told >= least),
joined AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) AS spans,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM kept GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
    t.text NOT IN (SELECT coalesce(text, '') FROM documents WHERE regexp_matches(source, '[02468]$')) AS scanned_now
FROM texts t LEFT JOIN joined USING (doc_id)
"""
