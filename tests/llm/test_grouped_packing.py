"""Packing: ids beside the library's, every piece once and gapless, few sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import grouped_packing as G, queries
from millrace.llm.common import stored

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "   a", "a  b", "a   b", "a \n b", "a\n b", "a\n\n b", "a\n  b", "\n", " \n \n", "it's 'tis don't they'LL", "a.b.c", "x .y", "é. É;ß:ſ.ǅ,", "日本語。テスト, かな", "🎉🎉!! 🎉",
       "1.5,2 ٣.٤", "a1 b2.c", "\nA", "\n\nA b", "a,\nb", "a,,\n\nb.", "x\n y", "¿qué? «sí»", "µm ªº ×÷", "<|endoftext|>", "a <|endoftext|> b", "tab\tand\x0bmore\x1c\x1d. x", "a b  c　d", "foo  bar", "...?!  ...", "x" * 5000, "\x00 a\x00.", "naïve, Ünïcode ", "_a_. _b", "end "]


def windows_of(counts, plan):
    """sequence, offset, length of every piece of a plan."""
    rows = np.array(sorted(plan.rows), np.int64)
    size, rank = np.repeat(np.arange(len(counts)), counts), np.concatenate([np.arange(c) for c in counts])
    row = rows[np.searchsorted((rows[:, 0] << 44) | rows[:, 1], (size << 44) | rank, "right") - 1]
    assert (row[:, 0] == size).all()
    k = rank - row[:, 1]
    return row[:, 3] + k // row[:, 2], row[:, 4] + k % row[:, 2] * size, size


def check_gapless(sequence, offset, size, capacity):
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], size[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    assert (o[first] == 0).all() and (o + n <= capacity).all() and (o[~first] == (o + n)[:-1][~first[1:]]).all()
    return int(first.sum())


def best_fit_decreasing(sizes, capacity):
    free = []
    for n in sorted(sizes, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=free.__getitem__)] -= n
        else:
            free.append(capacity - n)
    return len(free)


def test_ids_equal_the_library():
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(3)
    texts = ODD + ["".join(rng.choice([" ", " ", "\n", ".", ",", "'", "s", "a", "Z", "é", "ſ", "7", "٣", "-", " ", "\x1c", "日", ")"]) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    encoder = G.Encoder(open(PATH, encoding="utf-8").read())
    assert encoder.by_parts
    for _ in range(2):  # the second time from memory
        got = [encoder.encode(t) for t in texts]
        for t, ids in zip(texts, got):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_texts_are_encoded_in_windows(monkeypatch):
    monkeypatch.setattr(G, "WINDOW", 50)
    monkeypatch.setattr(G, "REMEMBERED", 20)
    encoder, text = G.Encoder(open(PATH, encoding="utf-8").read()), "Words of  a long\n text, which is cut; " * 40 + "x" * 300
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = G.Encoder(open(path, encoding="utf-8").read())
    assert not encoder.by_parts
    assert [np.frombuffer(x, "<u4").tolist() for x in map(encoder.encode, ODD)] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in ODD]


@pytest.mark.parametrize("draw,over", [
    (lambda r, n: r.integers(1, 257, n), 1.02), (lambda r, n: r.integers(60, 140, n), 1.05), (lambda r, n: r.integers(75, 95, n), 1.02), (lambda r, n: r.integers(100, 129, n), 1.01),
    (lambda r, n: np.where(r.random(n) < 0.4, 129, r.integers(1, 128, n)), 1.05), (lambda r, n: np.full(n, 256), 1.0), (lambda r, n: np.full(n, 1), 1.01)])
@pytest.mark.parametrize("n", [1, 7, 300, 4000])
def test_plans_are_gapless_and_no_worse_than_best_fit(draw, over, n):
    sizes = draw(np.random.default_rng(n), n)
    counts = np.bincount(sizes, minlength=257)
    plan = G.plan_packing(counts, groups=24)
    used = check_gapless(*windows_of(counts, plan), 256)
    assert used == plan.sequences >= -(-int(sizes.sum()) // 256)
    if n <= 300:
        assert used <= best_fit_decreasing(sizes.tolist(), 256)


def test_grouping_beats_best_fit_where_sizes_repeat_badly():
    """Thirds of the capacity: best fit decreasing pairs the long ones and strands the short."""
    sizes = np.random.default_rng(1).integers(75, 95, 3000)
    used = G.plan_packing(np.bincount(sizes, minlength=257), groups=24).sequences
    assert used <= 1.02 * sizes.sum() / 256 and used < 0.95 * best_fit_decreasing(sizes.tolist(), 256)


def test_fractional_optimum_of_a_known_case():
    """Sizes 6 and 4 of 10 in equal numbers pair up; 5 goes in twos."""
    got = G.configurations(np.array([6, 5, 4]), np.array([10.0, 8.0, 10.0]), 10)
    assert sum(n for _, n in got) == 14 and sum(p * n for p, n in got).tolist() == [10, 8, 10]


def test_query_rows(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = stored(queries.op12_grouped_packing(spark, sf_dir), "packed").collect()
    tokenizer, pieces = Tokenizer.from_file(PATH), {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(docs)
    for i, parts in pieces.items():
        ids = [*tokenizer.encode(docs[i], add_special_tokens=False).ids, 0]
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1].tolist()]
        assert sum(r.length for r in parts) == len(ids) and all(r.length == 2048 for r in parts[1:]) and 0 < parts[0].length <= 2048
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) for r in parts)
    sizes = [r.length for r in rows]
    used = check_gapless(*[np.array([r[c] for r in rows]) for c in ("sequence_id", "offset", "length")], 2048)
    assert used <= best_fit_decreasing(sizes, 2048) and used <= 1.02 * sum(sizes) / 2048 + 1


def test_awkward_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "no id"), (3, "again"), (3, "again"), (50, None), (51, "long text " * 900)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, length int, sequence_id string").repartition(3)
    packed = G.pack(G.cut_documents(docs, PATH, capacity=64, with_ids=True), 64)
    got = packed.collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows))
    assert sum(r.length for r in got) == sum(map(len, want)) and sum(r.piece == 0 for r in got) == len(rows)
    check_gapless(*[np.array([r[c] for r in got]) for c in ("sequence_id", "offset", "length")], 64)
    filled = G.sequences(packed).collect()
    assert all(len(r.ids) <= 64 and len(r.starts) == len(r.doc_ids) for r in filled) and sum(len(r.ids) for r in filled) == sum(map(len, want))
    assert G.pack(G.cut_documents(docs.limit(0), PATH)).count() == 0
    odd = spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, 65), (5, 64), (6, -3)], "k int, length int")
    assert {r.k: r.sequence_id is not None for r in G.pack(odd.withColumn("offset", F.lit("clash")), 64).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
