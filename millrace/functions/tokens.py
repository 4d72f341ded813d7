"""Word and punctuation tokens with hashed ids, label masks and padding.

The tokenizer is a parameter of every job. The default needs no vocabulary: words and single marks by
one pattern, ids by a hash. ``offset_tokenizer`` plugs in any tokenizer that reports character offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, functions as F

from millrace.functions.text import let, starts_of

IGNORED = -100
PAD_ID, EOS_ID, FIRST_ID = 0, 1, 2
VOCAB = 50_000
EOS = "<|eos|>"
WORDS = r"<\|eos\|>|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def token_id(token: Column, vocab: int = VOCAB) -> Column:
    hashed = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")
    return F.when(token == EOS, EOS_ID).otherwise(F.pmod(hashed, F.lit(vocab)) + FIRST_ID).cast("int")


def pad_to(values: Column, length: Column | int, fill, left: bool = False) -> Column:
    """Array padded with ``fill`` to ``length``."""
    filler = F.array_repeat(F.lit(fill), (F.lit(length) if isinstance(length, int) else length) - F.size(values))
    return F.concat(filler, values) if left else F.concat(values, filler)


def attention(size: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when(i <= size, 1).otherwise(0))


def encode_fixed(text: Column, length: int, vocab: int = VOCAB) -> Column:
    """``struct<input_ids, attention_mask>``: cut at ``length`` (the rest of the text is dropped) and padded."""
    ids = F.transform(F.slice(tokens(text), 1, length), lambda t: token_id(t, vocab))
    return let(ids, lambda x: F.struct(pad_to(x, length, PAD_ID).alias("input_ids"),
                                       let(F.size(x), lambda n: attention(n, length)).alias("attention_mask")))


def causal_labels(ids: Column, mask: Column) -> Column:
    """Ids where attended, else ignored; a real end token equal to the pad id stays."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 0, IGNORED).otherwise(i))


def offset_tokenizer(encode: Callable[[str], Iterable[tuple[int, int, int]]], length: int) -> Callable[[Column], Column]:
    """A tokenizer that yields ``(id, start, end)`` as a column function, cut at ``length`` tokens.

    It runs on Arrow batches; one text at a time is held.
    """

    @F.pandas_udf("ids array<int>, starts array<int>, ends array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        ids, starts, ends = [], [], []
        for text in texts:
            row = []
            for token in encode(text):
                if len(row) == length:
                    break
                row.append(token)
            ids.append([t[0] for t in row])
            starts.append([t[1] for t in row])
            ends.append([t[2] for t in row])
        return pd.DataFrame({"ids": ids, "starts": starts, "ends": ends})

    return run


def word_tokens(length: int, vocab: int = VOCAB) -> Callable[[Column], Column]:
    """The default tokens with ids and character offsets as ``struct<ids, starts, ends>``, cut at ``length``. Blanks are matched as
    well, so that offsets are sums of lengths; at most one run of them follows a token."""
    def placed(pieces):
        starts = starts_of(F.transform(pieces, F.length))
        whole = F.zip_with(pieces, starts, lambda t, at: F.struct(t.alias("t"), at.alias("at")))
        return F.slice(F.filter(whole, lambda p: ~p["t"].rlike(r"\A\s")), 1, length)

    def run(text):
        pieces = F.slice(F.regexp_extract_all(text, F.lit(WORDS + r"|\s+"), F.lit(0)), 1, 2 * length + 1)
        return let(let(pieces, placed), lambda kept: F.struct(
            F.transform(kept, lambda p: token_id(p["t"], vocab)).alias("ids"), F.transform(kept, lambda p: p["at"]).alias("starts"),
            F.transform(kept, lambda p: p["at"] + F.length(p["t"])).alias("ends")))

    return run


def span_labels(ids: Column, starts: Column, ends: Column, spans: Column, eos_id: int = EOS_ID) -> Column:
    """Id of each token lying wholly inside one span, else ignored; a last end token is always trained."""
    placed = F.arrays_zip(ids.alias("id"), starts.alias("s"), ends.alias("e"))
    labels = F.transform(placed, lambda t, i: F.when(
        ((t["s"] < t["e"]) & F.exists(spans, lambda p: (t["s"] >= p["start"]) & (t["e"] <= p["end"])))
        | ((i == F.size(ids) - 1) & (t["id"] == eos_id)), t["id"]).otherwise(IGNORED))
    return labels


def trim_completion(ids: Column, pad_id: int, eos_id: int) -> Column:
    """Completion without padding. When pad and end token are the same, kept through the first one."""
    if pad_id != eos_id:
        return F.filter(ids, lambda x: x != pad_id)
    first = F.array_position(ids, F.lit(eos_id)).cast("int")
    return F.when(first > 0, F.slice(ids, F.lit(1), first)).otherwise(ids)


def action_mask(total: Column, prompt_len: Column) -> Column:
    """Mask over ``total - 1`` predicted positions, true from the first completion token on."""
    return F.when(total >= 2, F.transform(F.sequence(F.lit(0), (total - 2).cast("int")), lambda i: i >= prompt_len - 1))


def is_truncated(ids: Column, pad_id: int, max_new_tokens: int, finish_reason: Column | None = None) -> Column:
    full = F.size(F.filter(ids, lambda x: x != pad_id)) >= max_new_tokens
    return full if finish_reason is None else full | (F.coalesce(finish_reason, F.lit("")) == "length")
