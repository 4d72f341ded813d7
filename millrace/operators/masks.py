"""Training examples: label masks, audits, batch padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import tokens as E
from millrace.functions.text import computed_once, strip
from millrace.operators.skew import join_groups


def sft_examples(df: DataFrame, tokenizer, length: int, text: str = "text", spans: str = "spans", min_chars: int = 10) -> DataFrame:
    """Fixed-length ``input_ids, attention_mask, labels``; short texts and rows with nothing to train on are dropped."""
    df = df.filter(F.length(strip(F.col(text))) >= min_chars)
    rest = [c for c in df.columns if c not in (text, spans)]
    cut = computed_once(df.select(*rest, spans, text), _t=tokenizer(F.col(text)))
    labels = E.span_labels(F.col("_t.ids"), F.col("_t.starts"), F.col("_t.ends"), F.col(spans))
    labelled = computed_once(cut.select(*rest, F.col("_t.ids").alias("ids"), labels.alias("_l")), _l=F.col("_l"))
    kept = labelled.filter(F.exists("_l", lambda x: x != E.IGNORED))
    return kept.select(*rest, E.pad_to(F.col("ids"), length, E.PAD_ID).alias("input_ids"),
                       E.attention(F.size("ids"), length).alias("attention_mask"),
                       E.pad_to(F.col("_l"), length, E.IGNORED).alias("labels"))


def _valid(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m == 1))


def mask_report(examples: DataFrame, *keys: str) -> DataFrame:
    trained = F.size(F.filter("labels", lambda x: x != E.IGNORED))
    return examples.select(*keys, _valid(F.col("attention_mask")).alias("valid_tokens"), trained.alias("trainable_tokens"),
                           (F.lit(100.0) * trained / _valid(F.col("attention_mask"))).alias("trainable_pct"))


def mask_listing(examples: DataFrame, *keys: str, first: int = 50) -> DataFrame:
    """Per-token TRAIN / MASKED listing of the first tokens of each example."""
    shown = F.least(_valid(F.col("attention_mask")), F.lit(first))
    pairs = F.slice(F.arrays_zip("input_ids", "labels"), F.lit(1), shown)
    return examples.select(*keys, F.posexplode(pairs).alias("pos", "p")).select(
        *keys, "pos", F.col("p.input_ids").alias("token_id"),
        F.when(F.col("p.labels") == E.IGNORED, "MASKED").otherwise("TRAIN").alias("marker"))


def pad_group(df: DataFrame, batch: str, order: str, vector: str, prompt_len: str, left: bool = True, fill=0.0) -> DataFrame:
    """Vectors padded to the longest of their batch; the batch takes its first row's prompt length."""
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("_max"),
                                  F.min_by(prompt_len, order).alias("batch_prompt_len"))
    padded = E.pad_to(F.col(vector), F.col("_max"), fill, left)
    return join_groups(df, sizes.drop("n"), [batch], sizes, spread=[order]).select(batch, order, padded.alias(vector), "batch_prompt_len")


def collate(df: DataFrame, batch: str, order: str, *columns: str) -> DataFrame:
    """Rows of a batch (of fixed size, hence bounded) as one record of arrays."""
    rows = df.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("_r"))
    return rows.select(batch, *[F.col(f"_r.{c}").alias(c) for c in (order, *columns)])


def unbatch(df: DataFrame, batch: str, *columns: str) -> DataFrame:
    """One row per element of a batch record; its text is cleared."""
    return (df.select(batch, F.posexplode(F.arrays_zip(*columns)).alias("pos", "z"))
            .select(batch, "pos", *[f"z.{c}" for c in columns], F.lit("").alias("text")))
