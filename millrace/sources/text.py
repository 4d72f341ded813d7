"""Reading and writing of text and JSONL corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.functions import paths as P
from millrace.functions.text import computed_once, strip
from millrace.operators.ordering import first_rows, within_total


# ---- files -------------------------------------------------------------------------------------
def base_suffix(path: str) -> tuple[str, bool]:
    """Suffix that decides the format, and whether the file is gzipped."""
    name = path.rsplit("/", 1)[-1].lower()
    zipped = name.endswith(".gz")
    stem = name[:-3] if zipped else name
    return ("." + stem.rsplit(".", 1)[-1] if "." in stem else ""), zipped


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Lines of a file as ``line``. A gzip file cannot be split, so its lines are dealt out after reading."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    if base_suffix(path)[1]:
        lines = lines.repartition(partitions or spark.sparkContext.defaultParallelism)
    return lines


def read_corpus(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Texts of a ``.txt`` or ``.jsonl`` file, gzipped or not, as ``text``."""
    suffix, _ = base_suffix(path)
    if suffix == ".json":
        raise ValueError("a JSON array is not a line corpus; use .jsonl or .txt")
    lines = read_lines(spark, path)
    return jsonl_texts(lines, strict=strict) if suffix == ".jsonl" else plain_texts(lines)


def read_preview(spark: SparkSession, path: str, rows: int = 20) -> DataFrame:
    """First records of a ``.jsonl``, ``.json`` (array, or one object of columns) or ``.csv`` file.

    Of an object of columns, the first value of each column is shown.
    """
    suffix, _ = base_suffix(path)
    if suffix == ".csv":
        return spark.read.option("header", True).csv(path).limit(rows)
    df = spark.read.option("multiLine", suffix == ".json").json(path).limit(rows)
    if suffix != ".json":
        return df
    opening = spark.read.text(path).select(F.substring(strip(F.col("value")), 1, 1).alias("c")).filter("c <> ''").first()
    if opening is None or opening["c"] != "{":
        return df
    return df.select(*[(F.try_element_at(f.name, F.lit(1)) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)).alias(f.name)
                       for f in df.schema.fields])


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Corpus files under a folder with their size; file contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length"))
    kept = F.lower("path").rlike(r"\.(jsonl|txt|txt\.gz|jsonl\.gz)$")
    return files.filter(kept).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path",
                                     F.col("length").alias("bytes"), F.round(F.col("length") / 1048576, 2).alias("size_mb"))


def write_jsonl(df: DataFrame, path: str, line: str = "line", gzip: bool = False) -> None:
    df.select(F.col(line).alias("value")).write.mode("append").option(
        "compression", "gzip" if gzip else "none").text(path)


# ---- lines already in a frame --------------------------------------------------------------------
def plain_texts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Stripped non-blank lines as ``text``."""
    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, strip(F.col(line)).alias("text")).filter("text <> ''")


def jsonl_texts(lines: DataFrame, line: str = "line", strict: bool = True) -> DataFrame:
    """``text`` of each JSON line; lines that do not parse are skipped.

    ``strict`` strips the text and drops it when empty or missing; otherwise a missing text is ``''``.
    """
    rest = [c for c in lines.columns if c != line]
    texts = (computed_once(lines.select(*rest, line), _v=P.parse(F.col(line))).filter("_v IS NOT NULL")
             .select(*rest, F.coalesce(F.try_variant_get("_v", "$.text", "string"), F.lit("")).alias("text")))
    return computed_once(texts, text=strip(F.col("text"))).filter("text <> ''") if strict else texts


def records(lines: DataFrame, line: str = "line", keep_line: bool = False) -> DataFrame:
    """JSON lines as VARIANT ``record``; blank and broken lines are skipped."""
    rest = [c for c in lines.columns if c != line or keep_line]
    return computed_once(lines, record=P.parse(F.col(line))).filter("record IS NOT NULL").select(*rest, "record")


def audit(lines: DataFrame, formatted: Column, line: str = "line", min_chars: int = 10) -> DataFrame:
    """One row of counters over JSON lines: total, parsed, skipped, valid, and a warning above 10 % skipped.

    ``formatted`` renders the training text from the VARIANT column ``record`` (null when it cannot).
    """
    parsed = computed_once(lines.select(line), record=P.parse(F.col(line)))
    ok = F.coalesce(F.length(strip(formatted)) >= min_chars, F.lit(False))
    counts = parsed.agg(F.count(F.lit(1)).alias("total_lines"), F.count("record").alias("parsed"),
                        F.count_if(ok).alias("valid_examples"))
    skipped = F.col("total_lines") - F.col("valid_examples")
    return counts.select("total_lines", "parsed", skipped.alias("skipped"), "valid_examples",
                         (skipped / F.greatest(F.lit(1), F.col("total_lines")) > 0.1).alias("warn"))


def prompt_records(lines: DataFrame, prompt_key: str = "prompt", answer_key: str = "answer",
                   line: str = "line") -> DataFrame:
    """Prompt records of JSON lines, the whole record kept as ``metadata``. Blank lines are skipped,
    a broken line is an error."""
    rest = [c for c in lines.columns if c != line]
    body = F.nullif(strip(F.col(line)), F.lit(""))
    full = computed_once(lines.select(*rest, line), metadata=F.parse_json(body)).filter("metadata IS NOT NULL")
    m = F.col("metadata")
    return full.select(*rest, P.text_at(m, prompt_key).alias("prompt"), P.text_at(m, answer_key).alias("reference_answer"), "metadata")


def from_records(df: DataFrame, record: str, prompt_key: str = "prompt", answer_key: str = "answer") -> DataFrame:
    """Prompt records from a map column; a record without one of the keys is an error."""
    def need(key: str) -> Column:
        missing = F.raise_error(F.lit(f"record without {key}"))
        return F.when(F.map_contains_key(record, key), F.try_element_at(record, F.lit(key))).otherwise(missing)

    rest = [c for c in df.columns if c != record]
    return df.select(*rest, need(prompt_key).alias("prompt"), need(answer_key).alias("reference_answer"),
                     F.col(record).alias("metadata"))


def field_preview(df: DataFrame, order: str, record: str = "record", rows: int = 20) -> DataFrame:
    """Union of the top-level fields of the first ``rows`` records, with their count and a sample value."""
    first = df.select(order, record).orderBy(order).limit(rows)
    fields = F.try_variant_get(record, "$", "map<string,variant>")
    long = first.select(order, F.explode(fields).alias("field", "value"))
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("present"),
                                     F.min_by(P.as_text(F.col("value")), F.col(order)).alias("example"))


# ---- predicates and caps -------------------------------------------------------------------------
def min_score(value: Column, minimum: float) -> Column:
    """False only for a number below the minimum; null and text pass."""
    return ~F.coalesce(value.try_cast("double") < minimum, F.lit(False))


def has_word(value: Column, target: str) -> Column:
    """Case-blind containment; null passes."""
    return F.coalesce(F.contains(F.lower(value), F.lit(target.lower())), F.lit(True))


def byte_cap(df: DataFrame, key: str, line: Column, cap: int) -> DataFrame:
    """Longest prefix in key order whose lines, with line ends, fit into ``cap`` bytes."""
    sized = df.withColumn("bytes", (F.octet_length(line) + 1).cast("bigint"))
    return within_total(sized, key, "bytes", cap, "total_bytes")


def extract(lines: DataFrame, key: str, score_field: str | None = None, minimum: float | None = None,
            lang_field: str | None = None, lang: str | None = None, max_rows: int | None = None,
            max_bytes: int | None = None, line: str = "line") -> DataFrame:
    """Filtered and capped part of a JSON-line corpus, ready for ``write_jsonl``."""
    kept = records(lines, line, keep_line=True)
    if score_field is not None and minimum is not None:
        kept = kept.filter(min_score(F.try_variant_get("record", f"$.{score_field}", "string"), minimum))
    if lang_field is not None and lang is not None:
        kept = kept.filter(has_word(F.try_variant_get("record", f"$.{lang_field}", "string"), lang))
    kept = kept.drop("record")
    if max_rows is not None:
        kept = first_rows(kept, key, max_rows)
    if max_bytes is not None:
        kept = byte_cap(kept, key, F.col(line), max_bytes)
    return kept
