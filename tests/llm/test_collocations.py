import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.oracle import compare
from vistalake.llm import collocations as C
from vistalake.llm import queries


def test_equals_sql(spark):
    assert len(compare(spark, "/root/testdata/sf0.001", queries.QUERIES["op11_collocations"], queries.SQL["op11_collocations"])) > 20


def brute(rows, least, top=2000):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(upper)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = {(lang, p[i : i + s]) for (lang, p), a in cand.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if f[lang, p[i : i + s]] <= a}
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def texts(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "é", "Straße", "İ", "A-b", "x" * 600, "　"]
    out = []
    for _ in range(n):
        t = ""
        for _ in range(r.randint(0, 30)):
            t += r.choice(words).upper() if r.random() < 0.2 else r.choice(words[: r.randint(1, len(words))])
            t += r.choice([" ", " ", " ", "\t", "  ", ".", ", ", "\n", "\x0b", "\r", "!?", " one Two three FOUR five six "])
        out.append((t, r.choice(["en", "en", "en", "de", None, "und"])))
    return out + [(None, "en"), ("", "de"), ("   ", None), (".", "zz"), (" ".join(["long text here"] * 3000), "long")]


def frame(spark, rows):
    return spark.createDataFrame([(t, x, "k", i, 3) for i, (t, x) in enumerate(rows)], "text string, lang string, phrase string, key int, n int").repartition(4, "key")


def same(spark, rows, least, **more):
    got = sorted(tuple(r) for r in C.mine(frame(spark, rows), least, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, least, **more)
    return got


def test_brute_force(spark):
    assert len(same(spark, texts(150, 1) * 2, 5)) > 100


def test_ties_at_the_end_and_few_phrases(spark):
    assert len(same(spark, [("b a. c a. d a. e a", "x")] * 3 + [(" ".join("pqrstuvw"), "y")] * 4, 3, top=2)) == 4


def test_border_failures_are_counted_by_further_passes(spark):
    """The sample holds none of the documents with the phrase: its words, then its longer parts, fail at the border."""
    rows = [(f"zq{i} rare", "en") for i in range(60)] + [("Alpha beta Gamma delta epsilon zeta", "en")] * 1
    df = frame(spark, rows)
    row = F.xxhash64(*df.columns)
    # copies of one text are told apart by their other columns: keep only those outside the sample
    grown = df.crossJoin(spark.range(60).withColumnRenamed("id", "copy")).filter("text like 'Alpha%'").withColumn("row", F.xxhash64(row, "copy")).filter(F.pmod(F.xxhash64("row", "text"), F.lit(C.SAMPLE)) != 0)
    given = grown.select("text", "lang", "row").unionByName(df.filter("text not like 'Alpha%'").select("text", "lang", row.alias("row")))
    found, passes = C.frequent(given, 20)
    n = grown.count()
    assert passes == 2 and n > 20
    assert sorted((r["n"], r["count"]) for r in found.collect() if r["count"] == n) == [(k, n) for k in range(1, 6) for _ in range(7 - k)]


def test_empty(spark):
    assert C.mine(frame(spark, [("a", "b")]).limit(0)).count() == 0
    assert C.mine(frame(spark, [(None, None), ("", "x")])).count() == 0


def test_whole_texts_are_read_three_times(spark):
    """Once for the sample and by two passes: the second one, which a failing border asks for, also spells what the sample did not."""
    rows = texts(150, 2) * 2 + [(f"only here {i % 3} and there", "en") for i in range(9)]
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    given = frame(spark, rows)
    got = C.mine(given.mapInArrow(counting, given.schema), 5).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5)
    assert read.value <= 3 * len(rows)


def test_samples_of_all_and_of_none(spark, monkeypatch):
    rows = texts(80, 3) * 2
    for share in (1, 10**9):
        monkeypatch.setattr(C, "SAMPLE", share)
        assert len(same(spark, rows, 5)) > 50


def test_a_phrase_beside_the_sample_without_failures(spark):
    """Five words whose parts the sample proposes, but which it never holds: nothing fails, and a pass over all texts spells them."""
    row = F.xxhash64("text", "id")
    drawn = F.pmod(F.xxhash64("row", "text"), F.lit(C.SAMPLE)) == 0
    made = lambda text: spark.range(1000).select(F.lit(text).alias("text"), F.lit("en").alias("lang"), "id").withColumn("row", row).drop("id")
    given = made("ax bx cx dx. bx cx dx ex").filter(drawn).unionByName(made("ax bx cx dx ex").filter(~drawn))
    found, known, words, passes = C.spelled(given, 100)
    n = given.filter("text = 'ax bx cx dx ex'").count()
    assert passes == 1 and {r.phrase: r.a for r in known.collect()}["ax bx cx dx ex"] == n > 800
    assert [(r["lang"], r["n"]) for r in words.collect()] == [("en", 5 * n + 8 * (given.count() - n))]


def test_words_of_all_lengths_have_hashes_of_their_own():
    """A word's hashes depend on its bytes and nothing around it."""
    r = random.Random(4)
    words = sorted({bytes(r.choice(b"ab") for _ in range(k)) for k in [*range(1, 40), 511, 512, 513, 600] for _ in range(20)})
    own = C.lanes_of(words)
    assert len({a for a, _ in own.tolist()}) == len({b for _, b in own.tolist()}) == len(words)
    data = b" ".join(words)
    first = [data.index(b" " + w + b" ") + 1 for w in words[1:-1]]
    one, two = C.lanes(np.frombuffer(data, np.uint8), np.array(first), np.array([f + len(w) for f, w in zip(first, words[1:-1])]))
    assert one.tolist() == own[1:-1, 0].tolist() and two.tolist() == own[1:-1, 1].tolist()


def test_counts_travel_in_as_many_batches_for_any_number_of_parts():
    r = np.random.default_rng(5)
    a = np.zeros(50_000, C.COUNTED)
    a["key"], a["check"], a["n"] = np.sort(r.integers(0, 2**64, len(a), np.uint64)), r.integers(0, 2**32, len(a)), r.choice([1, 1, 1, 7], len(a))
    for parts in (1, 40, 2000):
        batches = list(C.packed(3, a, parts))
        assert [b.column("n").unique().to_pylist() for b in batches] == [[-3], [3]] and max(len(b) for b in batches) <= parts
        back = np.concatenate([C.unpacked(b.column("body"), n < 0) for b, n in zip(batches, (-3, 3))])
        assert np.array_equal(np.sort(back, order="key"), a)
        one = batches[0].slice(len(batches[0]) - 1)
        assert set(C.part_of(C.unpacked(one.column("body"), True)["key"], parts).tolist()) == set(one.column("part").to_pylist())
