import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from vistalake.llm import packing, token_counts
from vistalake.llm.wordwise import PieceCounter, WordEncoder

PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "  ", "a ", " a", "a  b", "a\tb\n\nc", "▁", "▁x ▁", "é😀 日本語 x, y. z", "<s> </s> <unk> <0x0A>", "\x00 a", "a" * 5000,
       "don't we'll 123 A.B,C!! <|endoftext|>x <|startoftext|>", "é ́x ≠", "a\x1cb \x85 c\xa0d", "İ ΣΑΣ ς", "x<|endoftext|>y", "a,\n.b, ,c. »,", "word " * 9000]


def real():
    import duckdb

    return [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()]


def test_words_make_the_whole():
    texts = [t or "" for t in ODD] + real()
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert PieceCounter(PIECE).counts(texts) == [len(x) for x in sp.encode(texts)]
    enc, tok = WordEncoder(WORD), Tokenizer.from_file(WORD)
    for t, w in zip(texts, enc.word_numbers([t.encode() for t in texts])):
        assert enc.ids_of(w).tolist() == tok.encode(t, add_special_tokens=False).ids, t[:50]


def test_token_counts_and_cache(spark, tmp_path):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = ODD + real()[:60]
    rows = [(i, t, 5) for i, t in enumerate(texts + texts[:9])]
    docs = spark.createDataFrame([*rows, rows[3], (None, "x", 1)], "doc_id long, text string, n_tokens int")
    cache = str(tmp_path / "cache")
    got = token_counts.count_tokens(docs, PIECE, cache).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        t = "x" if r.doc_id is None else texts[r.doc_id % len(texts)] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(sp.encode(t))) and r.over_limit == (r.n_tokens > 4096)
    n = spark.read.parquet(cache).select("digest").distinct().count()
    assert n == len({t or "" for t in texts} | {"x"})
    more = docs.unionByName(spark.createDataFrame([(900, "brand new", 1)], docs.schema))
    files = spark.read.parquet(cache).count()
    token_counts.count_tokens(more, PIECE, cache).count()
    assert spark.read.parquet(cache).count() == files + 1
    assert token_counts.count_tokens(docs.limit(0), PIECE, str(tmp_path / "other")).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_documents(spark):
    tok = Tokenizer.from_file(WORD)
    texts = ODD + real()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(1, "", 1)] * 300, "doc_id long, text string, length int").repartition(3)
    got = packing.pack_documents(docs, WORD).collect()
    n = check_packing(got, 4096)
    assert n == -(-sum(r.length for r in got) // 4096)
    pieces = Counter()
    for r in got:
        ids = [*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        part = ids[r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(part) == r.length and (r.length == 4096 or r.start + r.length == len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r.doc_id] += 1
    assert len(pieces) == len(texts) and pieces[1] == 301
    assert packing.pack_documents(docs.limit(0), WORD).count() == 0


def best(items, capacity):
    """The least number of sequences, by trying all."""
    items = sorted(items, reverse=True)
    found = [len(items)]

    def go(i, rooms):
        if len(rooms) >= found[0]:
            return
        if i == len(items):
            found[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, rooms[:k] + (rooms[k] - items[i],) + rooms[k + 1 :])
        go(i + 1, (*rooms, capacity - items[i]))

    go(0, ())
    return found[0]


def test_reduction_loses_nothing():
    rng = random.Random(7)
    reduced = 0
    for _ in range(300):
        capacity = rng.choice([10, 20, 33])
        items = [rng.randint(max(1, capacity // 5), capacity) for _ in range(rng.randint(1, 9))]
        left = packing._Lengths(Counter(items))
        used = 0
        for j in sorted(left.count, reverse=True):
            while j in left.count and (others := packing.dominating(left, j, capacity)) is not None:
                used += 1
                for x in (j, *others):
                    left.take(x, 1)
        reduced += used
        rest = list(itertools.chain.from_iterable([k] * n for k, n in left.count.items()))
        assert used + best(rest, capacity) == best(items, capacity), (capacity, items)
    assert reduced > 300


def test_plan_places_each_once():
    rng = random.Random(3)
    for _ in range(50):
        counts = Counter(rng.choices(range(1, 65), k=rng.randint(1, 400)))
        runs, figures = packing.plan(counts, 64)
        placed, used = {}, Counter()
        for length, a, n, m, s, o in runs:
            for i in range(n):
                assert (length, a + i) not in placed
                placed[length, a + i] = (s + i // m, o + i % m * length)
        assert len(placed) == sum(counts.values())
        spans = {}
        for (length, _), (s, o) in placed.items():
            spans.setdefault(s, []).append((o, length))
        assert set(spans) == set(range(figures["sequences"]))
        for x in spans.values():
            at = 0
            for o, n in sorted(x):
                assert o == at
                at += n
            assert at <= 64
        assert figures["lower_bound"] <= figures["sequences"] <= 1.15 * figures["lower_bound"] + 1


def test_words_of_texts_in_a_row():
    # a mark at the end of one text doesn't look into the next, and a call's distinct words meet the memo once
    texts = ["x,", " y. z", "a.", "\nb", "", ",", ". ", "c,<|endoftext|> d", "é, f"]
    enc, tok = WordEncoder(WORD), Tokenizer.from_file(WORD)
    joined = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    numbers, cuts = enc.numbered(np.frombuffer(joined, np.uint8), offsets)
    for i, t in enumerate(texts):
        assert enc.ids_of(numbers[cuts[i] : cuts[i + 1]]).tolist() == tok.encode(t, add_special_tokens=False).ids, t
