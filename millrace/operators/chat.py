"""Chat and instruction rendering with the character spans a model is trained on.

A conversation is one record: ``messages array<struct<role, content>>``. Rendering is a Column
expression over that record; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.text import let, starts_of, strip

# Default tags and system text.
SYSTEM = "You are a helpful assistant."
TAGS = {"system": SYSTEM, "user_tag": "### User:", "bot_tag": "### Assistant:", "separator": "\n\n"}
IM_START, IM_END = "<|im_start|>", "<|im_end|>"


def assemble(df: DataFrame, by: str, order: str, fields: list[str], name: str = "messages") -> DataFrame:
    """Message rows to one record per conversation, which is the unit that the renderings work on."""
    item = F.struct(order, *fields)
    gathered = df.groupBy(by).agg(F.sort_array(F.collect_list(item)).alias(name))
    return gathered.withColumn(name, F.transform(name, lambda m: F.struct(*[m[f].alias(f) for f in fields])))


def normalise_roles(messages: Column, roles: Mapping[str, str], role_field: str = "role",
                    content_field: str = "content", default_system: str | None = SYSTEM) -> Column:
    """Messages with standard roles; other roles are dropped and a missing system message is put first.

    ``roles`` maps a role as found in the data to system, user or assistant.
    """
    table = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    known = F.filter(messages, lambda m: m[role_field].isin(*roles))
    standard = F.transform(known, lambda m: F.struct(F.try_element_at(table, m[role_field]).alias("role"),
                                                     F.coalesce(m[content_field], F.lit("")).alias("content")))
    if default_system is None:
        return standard
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(default_system).alias("content")))
    return let(standard, lambda s: F.when(F.exists(s, lambda m: m["role"] == "system"), s).otherwise(F.concat(first, s)))


def has_role(messages: Column, role: str) -> Column:
    return F.exists(messages, lambda m: m["role"] == role)


def segment(text: Column, trainable: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(trainable).alias("train"))


def spans_of(segments: Column) -> Column:
    """Segments to ``struct<text, spans>``: the joined text and the character range of every trainable part.

    Empty segments leave no span.
    """
    starts = starts_of(F.transform(segments, lambda s: F.length(s["text"])))
    placed = F.zip_with(segments, starts, lambda s, at: F.struct(at.alias("start"), (at + F.length(s["text"])).alias("end"), s["train"].alias("train")))
    kept = F.filter(placed, lambda p: p["train"] & (p["end"] > p["start"]))
    spans = F.transform(kept, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return F.struct(F.array_join(F.transform(segments, lambda s: s["text"]), "").alias("text"), spans.alias("spans"))


def chat_segments(messages: Column, eos: str = "", tags: Mapping[str, str] = TAGS) -> Column:
    """Tagged segments of standard-role messages; null without an assistant turn.

    Only the first system message is looked at, and a blank one gives way to the default.
    """
    sep = F.lit(tags["separator"])
    said = F.try_element_at(F.filter(messages, lambda m: m["role"] == "system"), F.lit(1))["content"]
    system = F.when(strip(said) != "", said).otherwise(F.lit(tags["system"]))

    def turn(m):
        user = F.array(segment(F.concat(F.lit(tags["user_tag"] + "\n"), m["content"], sep), False))
        bot = F.array(segment(F.lit(tags["bot_tag"]), False), segment(F.concat(F.lit("\n"), m["content"], sep), True))
        return F.when(m["role"] == "user", user).otherwise(bot)

    turns = F.flatten(F.transform(F.filter(messages, lambda m: m["role"] != "system"), turn))
    whole = F.concat(F.array(segment(F.concat(system, sep), False)), turns, F.array(segment(F.lit(eos), True)))
    return F.when(has_role(messages, "assistant"), whole)


def instruct_segments(instruction: Column, output: Column, system: Column | None = None, eos: str = "",
                      tags: Mapping[str, str] = TAGS) -> Column:
    """Tagged segments of an instruction pair; null when the output is blank."""
    sep = tags["separator"]
    default = F.lit(tags["system"])
    said = default if system is None else F.when(strip(F.coalesce(system, F.lit(""))) != "", system).otherwise(default)
    parts = F.array(segment(F.concat(said, F.lit(sep)), False),
                    segment(F.concat(F.lit(tags["user_tag"] + "\n"), instruction, F.lit(sep)), False),
                    segment(F.lit(tags["bot_tag"]), False),
                    segment(F.concat(F.lit("\n"), output, F.lit(sep)), True), segment(F.lit(eos), True))
    return F.when(strip(output) != "", parts)


def render(segments: Column) -> Column:
    """``struct<text, spans>``, null for null segments."""
    return F.when(segments.isNotNull(), let(segments, spans_of))


def text_only(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def chatml(messages: Column, generation: bool = False) -> Column:
    body = F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit(IM_START), m["role"], F.lit("\n"), m["content"], F.lit(IM_END + "\n"))), "")
    return F.concat(body, F.lit(IM_START + "assistant\n")) if generation else body


def chatml_instruct(instruction: Column, output: Column, extra: Column | None = None, system: str = SYSTEM) -> Column:
    """ChatML of one instruction pair, with optional input and no separator after the last tag."""
    user = instruction
    if extra is not None:
        user = F.concat(instruction, F.when(F.coalesce(extra, F.lit("")) != "", F.concat(F.lit("\n\nInput: "), extra)).otherwise(""))
    return F.concat(F.lit(f"{IM_START}system\n{system}{IM_END}\n{IM_START}user\n"), user,
                    F.lit(f"{IM_END}\n{IM_START}assistant\n"), output, F.lit(IM_END))


def chatml_spans(messages: Column, eos: str = "", min_chars: int = 10) -> Column:
    """``struct<text, spans>`` by rendering up to and through each assistant turn.

    A span runs from the end of the text before the turn, with the generation prompt, to the end of the
    text through the turn. An end mark the text lacks is added and trained. Null without an assistant turn.
    """
    lead = len(IM_START + "assistant\n")

    def size(m):
        return F.length(m["role"]) + F.length(m["content"]) + len(IM_START + IM_END) + 2

    placed = F.zip_with(messages, starts_of(F.transform(messages, size)), lambda m, at: F.struct(
        (at + lead).alias("start"), (at + size(m)).alias("end"), (m["role"] == "assistant").alias("bot")))
    kept = F.filter(placed, lambda p: p["bot"] & (p["end"] > p["start"]))
    spans = F.transform(kept, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))

    def close(t):
        if not eos:
            return F.struct(t.alias("text"), spans.alias("spans"))
        size = F.length(t)
        tail = F.array(F.struct(size.alias("start"), (size + len(eos)).alias("end")))
        return F.when(t.endswith(eos), F.struct(t.alias("text"), spans.alias("spans"))).otherwise(
            F.struct(F.concat(t, F.lit(eos)).alias("text"), F.concat(spans, tail).alias("spans")))

    whole = let(chatml(messages), lambda t: F.when(F.length(strip(t)) >= min_chars, close(t)))
    return F.when(has_role(messages, "assistant"), whole)


def plain(messages: Column, generation: bool = False) -> Column:
    names = F.create_map(*[F.lit(x) for x in ("system", "System", "user", "User", "assistant", "Assistant")])
    known = F.filter(messages, lambda m: m["role"].isin("system", "user", "assistant"))
    body = F.array_join(F.transform(known, lambda m: F.concat(
        F.try_element_at(names, m["role"]), F.lit(": "), m["content"], F.lit("\n\n"))), "")
    return F.concat(body, F.lit("Assistant: ")) if generation else body


# System texts by answer format.
SYSTEM_TEXTS = {
    "deepseek": """A conversation between User and Assistant. The user asks a question, and the Assistant solves it.
The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., <think> reasoning process here </think>
<answer> answer here </answer>""",
    "simple": """Отвечай строго в формате:
<reasoning>
(Шаги решения)
</reasoning>
<answer>
(Короткий итоговый ответ)
</answer>""",
    "russian": """Ты — умный помощник. Решай задачи пошагово.
Сначала подробно рассуждай в теге <reasoning>...</reasoning>,
затем дай краткий ответ в теге <answer>...</answer>.

Пример:
<reasoning>
Дано: ...
Нужно найти: ...
Решение: ...
</reasoning>
<answer>
42
</answer>""",
    "gsm8k": """You are a helpful assistant that solves math problems step by step.
Show your reasoning process, then provide the final numerical answer after ####.

Example format:
Let me solve this step by step.
Step 1: ...
Step 2: ...
Therefore, the answer is X.
#### X""",
}


def reasoning_prompt(question: Column, style: str = "deepseek", custom: str | None = None) -> Column:
    """``struct<messages, text>``: the chat messages of a question and their plain rendering."""
    system = custom or SYSTEM_TEXTS.get(style, SYSTEM_TEXTS["deepseek"])
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                       F.struct(F.lit("user").alias("role"), question.alias("content")))
    text = F.concat(F.lit(system + "\n\nUser: "), question, F.lit("\n\nAssistant:"))
    return F.struct(messages.alias("messages"), text.alias("text"))


def message_text(value: Column) -> Column:
    """Text of a completion given as VARIANT text, message list (first item) or message."""
    first = F.try_variant_get(value, "$[0]", "variant")
    kind = F.schema_of_variant(value)
    return (F.when(kind.startswith("ARRAY"), F.coalesce(F.try_variant_get(first, "$.content", "string"),
                                                        F.when(F.schema_of_variant(first) == "STRING", F.try_variant_get(first, "$", "string")),
                                                        F.to_json(value)))
            .when(kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(value, "$.content", "string"), F.to_json(value)))
            .otherwise(F.try_variant_get(value, "$", "string")))


def last_user_message(value: Column) -> Column:
    """Question of a prompt: its last user message, else the content of its last message, else its text."""
    items = F.try_variant_get(value, "$", "array<variant>")
    users = F.filter(items, lambda m: (F.try_variant_get(m, "$.role", "string") == "user")
                     & F.try_variant_get(m, "$.content", "string").isNotNull())
    picked = F.coalesce(F.try_element_at(users, F.lit(-1)), F.try_element_at(items, F.lit(-1)))
    kind = F.schema_of_variant(value)
    return (F.when(kind.startswith("ARRAY"), F.coalesce(F.try_variant_get(picked, "$.content", "string"), F.to_json(value)))
            .when(kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(value, "$.content", "string"), F.to_json(value)))
            .otherwise(F.try_variant_get(value, "$", "string")))
