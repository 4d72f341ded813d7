"""Schema discovery over open records, null-passing predicates, and mapping of records to prompts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions import paths as P
from millrace.functions.extract import final_answer
from millrace.functions.text import strip


# ---- discovery -----------------------------------------------------------------------------------
def record_schema(df: DataFrame, record: str) -> T.DataType:
    """Merged schema of all records: one aggregate over the corpus, one row to the driver."""
    text = df.agg(F.schema_of_variant_agg(record).alias("s")).first()["s"]
    return T.DataType.fromDDL(text.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING"))


def _walk(kind: T.DataType, path: str, depth: int, max_depth: int) -> list[tuple[str, str, int]]:
    if depth > max_depth or not isinstance(kind, T.StructType):
        return []
    found = []
    for field in kind.fields:
        here = f"{path}.{field.name}" if path else field.name
        inner = field.dataType
        if isinstance(inner, T.StructType):
            found += [(here, "folder", depth)] + _walk(inner, here, depth + 1, max_depth)
        elif isinstance(inner, T.ArrayType):
            found.append((here, "list", depth))
            if isinstance(inner.elementType, T.StructType):
                found += _walk(inner.elementType, f"{here}[]", depth + 1, max_depth)
            else:
                found.append((f"{here}[0]", "leaf", depth + 1))
        else:
            found.append((here, "leaf", depth))
    return found


def field_tree(df: DataFrame, record: str, max_depth: int = 10) -> DataFrame:
    """Every path of the records with its kind, depth and the number of records that have it."""
    tree = _walk(record_schema(df, record), "", 0, max_depth)
    r = F.col(record)
    hits = df.agg(*[F.count(F.nullif(P.as_text(P.get(r, path)), F.lit(""))).alias(f"c{i}") for i, (path, _, _) in enumerate(tree)])
    rows = [F.struct(F.lit(p).alias("path"), F.lit(k).alias("kind"), F.lit(d).alias("depth"), F.col(f"c{i}").alias("present"))
            for i, (p, k, d) in enumerate(tree)]
    return hits.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


# Field names and role words that tell a chat.
ROLE_NAMES = ["role", "from", "type"]
CONTENT_NAMES = ["content", "value", "text", "message"]
USER_WORDS = ["user", "human"]
ASSISTANT_WORDS = ["assistant", "gpt", "bot"]


def detect_format(df: DataFrame, record: str) -> DataFrame:
    """One row: chat or instruct, the fields that hold messages, role and content, and the role words found."""
    schema = record_schema(df, record)
    for field in schema.fields if isinstance(schema, T.StructType) else []:
        kind = field.dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)):
            continue
        names = kind.elementType.names
        role = next((n for n in names if n.lower() in ROLE_NAMES), None)
        content = next((n for n in names if n.lower() in CONTENT_NAMES), None)
        if role and content:
            items = F.try_variant_get(record, f"$['{field.name}']", "array<variant>")
            word = F.try_variant_get("m", f"$['{role}']", "string")
            roles = df.select(F.explode(items).alias("m")).select(word.alias("w")).filter("w IS NOT NULL").distinct()
            low = F.lower("w")
            return roles.agg(F.lit("chat").alias("format"), F.lit(field.name).alias("messages_field"),
                             F.lit(role).alias("role_field"), F.lit(content).alias("content_field"),
                             F.min(F.when(low.contains("system"), F.col("w"))).alias("system_role"),
                             F.min(F.when(low.isin(USER_WORDS), F.col("w"))).alias("user_role"),
                             F.min(F.when(low.isin(ASSISTANT_WORDS), F.col("w"))).alias("assistant_role"))
    empty = [F.lit(None).cast("string").alias(n) for n in ("messages_field", "role_field", "content_field",
                                                           "system_role", "user_role", "assistant_role")]
    return df.sparkSession.range(1).select(F.lit("instruct").alias("format"), *empty)


# ---- predicates ----------------------------------------------------------------------------------
def min_chars(df: DataFrame, text: str, chars: int = 10) -> DataFrame:
    return df.filter(F.length(strip(F.col(text))) >= chars)


def required(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) != "" for c in columns]))


def answer_range(df: DataFrame, answer: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Keep numbers within the range; text passes."""
    number = F.replace(F.col(answer), F.lit(","), F.lit("")).try_cast("double")
    if low is not None:
        df = df.filter(F.coalesce(number >= low, F.lit(True)))
    if high is not None:
        df = df.filter(F.coalesce(number <= high, F.lit(True)))
    return df


# ---- mapping -------------------------------------------------------------------------------------
# Names tried, in this order, when the configured field is absent.
PROMPT_FALLBACKS = ["question", "prompt", "input", "instruction", "problem", "query", "text"]
REFERENCE_FALLBACKS = ["answer", "response", "output", "solution", "target", "completion"]


def suggest_fields(names: Sequence[str]) -> tuple[str | None, str | None]:
    """Prompt and reference field to offer for a data set with these fields; here ``label`` counts as a reference too."""
    prompt = next((n for n in PROMPT_FALLBACKS if n in names), None)
    return prompt, next((n for n in [*REFERENCE_FALLBACKS, "label"] if n in names), None)


def _pick(record: Column, field: str, fallbacks: Sequence[str]) -> Column:
    """The field, else the first fallback that is present, even if that one is null."""
    chosen = P.get(record, field)
    real = F.when(F.schema_of_variant(chosen) != "VOID", chosen)
    present = None
    for name in fallbacks:
        has = P.has_key(record, name)
        present = F.when(has, P.get(record, name)) if present is None else present.when(has, P.get(record, name))
    return P.truthy_text(F.coalesce(real, present))


def map_fields(df: DataFrame, record: str = "record", prompt_field: str = "question",
               reference_field: str = "answer") -> DataFrame:
    """Add ``raw_prompt``, ``raw_answer`` and ``reference`` (the final answer when marked by hashes)."""
    r = F.col(record)
    out = df.withColumns({"raw_prompt": _pick(r, prompt_field, PROMPT_FALLBACKS),
                          "raw_answer": _pick(r, reference_field, REFERENCE_FALLBACKS)})
    a = F.col("raw_answer")
    return out.withColumn("reference", F.when(a.contains("####"), final_answer(a)).otherwise(a))


def fill_template(template: str, prompt: Column, reference: Column, record: Column, fields: Sequence[str] = ()) -> Column:
    """Literal replacement of ``{{prompt}}``, ``{{reference}}`` and ``{{metadata.k}}``, in that order.

    Replaced are the ``fields``, wherever their mark stands by then (an inserted text may hold it), and after
    them all fields the template names. A field the record lacks leaves its mark in place.
    """
    out = F.replace(F.lit(template), F.lit("{{prompt}}"), prompt)
    out = F.replace(out, F.lit("{{reference}}"), reference)
    named = re.findall(r"\{\{metadata\.(.+?)\}\}", template)
    for k in dict.fromkeys([*fields, *named]):
        filled = F.replace(out, F.lit("{{metadata." + k + "}}"), P.text_at(record, k))
        out = F.when(P.has_key(record, k), filled).otherwise(out)
    return out


def metadata_map(record: Column, raw_prompt: Column, raw_answer: Column) -> Column:
    """Open metadata: full answer and raw prompt first, then every field of the record; the first writer wins."""
    own = F.create_map(F.lit("full_answer"), raw_answer, F.lit("raw_prompt"), raw_prompt)
    source = F.transform_values(F.try_variant_get(record, "$", "map<string,variant>"), lambda k, v: P.as_text(v))
    return F.map_concat(own, F.map_filter(source, lambda k, v: ~k.isin("full_answer", "raw_prompt")))


# Question and answer fields of the known sources.
SOURCE_FIELDS = {"gsm8k": ("question", "answer"), "gsm8k_ru": ("question", "answer"),
                 "math_ru": ("problem", "solution"), "mgsm": ("question", "answer_number")}


def adapt_sources(sources: Mapping[str, DataFrame], keep: Sequence[str]) -> DataFrame:
    """Sources with different field names under one schema."""
    parts = []
    for name, df in sources.items():
        q, a = SOURCE_FIELDS[name]
        parts.append(df.select(*keep, F.lit(name).alias("source"), F.coalesce(F.col(q), F.lit("")).alias("question"),
                               F.coalesce(F.col(a).cast("string"), F.lit("")).alias("answer")))
    return reduce(DataFrame.unionByName, parts)
