"""Text, fuzzy, highlight, vector and scoring functions on literals."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from holdfast.functions import embed, scoring, text, vector
from holdfast.functions.fuzzy import ratio_to, similarity, word_agreement
from holdfast.functions.highlight import same_word, span_of
from holdfast.operators import search as S
from holdfast.operators import windows
from holdfast.sources import files
from holdfast.sources.library import from_tables


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_fold_makes_confusable_letters_one():
    assert text.fold_text("Їжак, і кіт!") == text.fold_text("Ижак и кит")
    assert text.fold_text("п'ять") == text.fold_text("пять") == text.fold_text("п’ять")
    assert text.fold_text("  Straße — x ") == "strasse x"
    assert text.fold_text(None) == ""


def test_similarity_bears_distortion():
    assert similarity("вчора ми їздили до лісу по гриби", "їздили до лісу") > 0.95
    assert similarity("вчора ми издили до лесу по грибы", "їздили до лісу по гриби") >= 0.72
    assert similarity("the weather in the mountains was cold", "quarterly tax report") < 0.72
    assert similarity("", "abc") == similarity("abc", "") == similarity(None, "x") == 0
    long = "зовсім інші слова про погоду " * 60 + "забув парасольку в автобусі" + " і ще багато тексту далі" * 60
    assert similarity(long, "забув парасольку в автобусі") > 0.95


def test_ratio_column(spark):
    df = spark.createDataFrame([("a plain phrase in a text",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(ratio_to("plain phrase")(F.col("t"))).collect()]
    assert got[0] > 0.95 and got[1:] == [0, 0]
    assert df.select(word_agreement("t", "t")).first()[0] == 1.0


def test_phrase_scores_rise(spark):
    f = lambda r, n=3: value(spark, scoring.phrase_score(F.lit(r), n))
    assert f(0.71) == 0 and f(1.0) == 100 and f(0.72) == pytest.approx(88)
    assert f(1.0, 1) == pytest.approx(83.5) and f(1.0, 2) == pytest.approx(92.5)
    scores = [f(r) for r in (0.72, 0.8, 0.85, 0.9, 1.0)]
    assert scores == sorted(scores) and f(1.0, 1) < f(0.85, 4) and f(0.85, 4) >= 99


def test_calibrated_scores(spark):
    f = lambda s, m, d: value(spark, scoring.calibrated(F.lit(s), F.lit(m).cast("double"), F.lit(d).cast("double")))
    assert f(0.3, 0.3, 0.1) == 50 and f(0.9, None, None) == 50 and f(0.9, 0.1, 0.0) == 50
    assert f(0.5, 0.3, 0.1) == pytest.approx(100 / (1 + np.exp(-2.2)))


def test_exact_queries(spark):
    for q, want in [('"a b"', "a b"), ("«a b»", "a b"), ("“a\nb”", "a\nb"), ("a b", None), ('x "a b"', None), ('""', None), ("", None)]:
        assert text.exact_query(q) == want
        assert value(spark, text.exact_query_column(F.lit(q))) == want


def test_literal_containment(spark):
    f = lambda h, n: value(spark, text.literally_contains(F.lit(h), F.lit(n)))
    assert f("We  went\nto Town", "went to town") and not f("we went into town", "went to town") and not f("went to tawn", "went to town")


def test_mentions_do_not_overlap(spark):
    assert value(spark, text.mentions(F.lit("aaaa aa"), "aa")) == 3
    assert value(spark, text.mentions(F.lit("STRASSE straße"), "Straße")) == 2
    assert value(spark, text.mentions(F.lit("x"), " ")) == 0


@pytest.mark.parametrize("n", [0, 1, 40, 180, 181, 320, 321, 1000])
def test_chunks_cover_all_words(spark, n):
    words = [f"w{i}" for i in range(n)]
    t = "  " + "\n".join(words) + " "
    got = value(spark, text.chunk_array(F.lit(t)))
    if n <= 180:
        assert got == ([t.strip()] if n else [])
        return
    want, at = [], 0
    while True:
        want.append(" ".join(words[at : at + 180]))
        if at + 180 >= n:
            break
        at += 140
    assert got == want


def test_segment_chunks(spark):
    segments = [(float(i), " ".join(["w"] * n)) for i, n in enumerate([10, 55, 5, 60, 3])]
    df = spark.createDataFrame([(segments,), ([],)], "s array<struct<start: double, text: string>>")
    got = [[(c.ts_s, len(c.text.split())) for c in r[0]] for r in df.select(text.segment_chunks(F.col("s"))).collect()]
    assert got == [[(0.0, 65), (2.0, 65), (4.0, 3)], []]


def test_labels_and_snippets(spark):
    long = " ".join(f"w{i}" for i in range(30))
    assert value(spark, text.default_label(F.lit(long))) == " ".join(f"w{i}" for i in range(8)) + "…"
    assert value(spark, text.default_label(F.lit("one two"))) == "one two"
    assert value(spark, text.default_label(F.lit("  "))) == text.UNTITLED
    assert value(spark, text.snippet(F.lit(long))).endswith("w24…")
    assert value(spark, text.stem(F.lit("/a/b.c/name.tar.gz"))) == "name.tar"
    assert value(spark, text.stem(F.lit("plain"))) == "plain"


def test_names(spark):
    f = lambda x: value(spark, text.safe_name(F.lit(x)))
    assert f('a<b>:"c"/d\\e|f?*g') == "a b c d e f g" and f("") == f("...") == text.UNNAMED and len(f("x" * 300)) == 80
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, name string")
    assert sorted(r.name for r in text.unique_names(df, "name", "id", ".txt").collect()) == ["a (2).txt", "a.txt", "b.txt"]


def test_trigrams(spark):
    assert value(spark, text.trigrams(F.lit("ab"))) == ["ab"] and value(spark, text.trigrams(F.lit("abab"))) == ["aba", "bab"]
    assert value(spark, text.trigram_overlap(F.lit("abcd"), F.lit("xbcdx"))) == 0.5
    assert value(spark, text.trigram_overlap(F.lit(""), F.lit("x"))) == 0
    for q in ("abcd", "ab", "", "aaaa"):
        for t in ("xbcdx", "ab", "", "aaa", None):
            t = F.lit(t).cast("string")
            assert value(spark, text.trigram_overlap(q, t)) == value(spark, text.trigram_overlap(F.lit(q), t))


def test_moments(spark):
    f = lambda x: value(spark, text.parse_moment(F.lit(x)))
    assert f("2024-05-06T07:08:09Z") == f("2024-05-06T09:08:09+02:00") == f("2024:05:06 07:08:09") == datetime(2024, 5, 6, 7, 8, 9)
    assert f("soon") is None
    name = F.lit("library-20240506-070809123-daily")
    assert value(spark, text.backup_moment(name, F.lit(None).cast("timestamp"))) == datetime(2024, 5, 6, 7, 8, 9, 123000)
    assert value(spark, text.backup_reason(name)) == "daily"


def test_formats(spark):
    assert [value(spark, text.format_bytes(F.lit(n))) for n in (0, 512, 1536, 500 * 1024, 5 * 1024**3)] == ["0 B", "512 B", "1,5 KB", "500 KB", "5,0 GB"]
    assert value(spark, text.format_duration(F.lit(125.7))) == "2:05"
    assert [value(spark, text.plural_form(F.lit(n), "o", "f", "m")) for n in (1, 2, 5, 11, 12, 21, 22, 112)] == list("ofmmmofm")
    assert [value(spark, scoring.tier(F.lit(n))) for n in (80, 79.9, 70, 0)] == ["strong", "likely", "likely", "weak"]
    assert value(spark, scoring.match_position(F.lit(99.0), F.lit(100.0))) == 86 and value(spark, scoring.match_position(F.lit(1.0), F.lit(0.0))) is None
    assert value(spark, scoring.out_of_memory(F.lit("cublas failed: OUT OF MEMORY"))) and not value(spark, scoring.out_of_memory(F.lit("file not found")))


def test_spans(spark):
    def find_span(t, q):
        found = value(spark, span_of(F.lit(t), F.lit(q)))
        return found and (found.start, found.stop)

    assert find_span("we went to the market today", "went market") == (3, 21)
    assert find_span("nothing here", "zebra") is None and find_span("of in on", "of in") is None
    t = "bridge " + "filler " * 20 + "bridge river bridge"
    a, b = find_span(t, "bridge river")
    assert t[a:b] == "bridge river bridge"
    same = lambda x, y: value(spark, same_word(F.lit(x), F.lit(y)))
    assert same("книги", "книгою") and not same("книга", "конвалія") and same("ліс", "лісу") and not same("прибуток", "приклад")
    assert find_span("Іде дощ, а книгу забуто", "книга") == (11, 16) and find_span("", "x") is None


@pytest.mark.parametrize("seed", range(4))
def test_spans_against_every_stretch(spark, seed):
    """All stretches of at most twelve words, the first of the best."""
    r = random.Random(seed)
    texts = [" ".join(r.choice(["river", "stones", "of", "bank", "the", "cold", "xyz"]) for _ in range(r.randrange(1, 26))) for _ in range(60)]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(span_of(F.col("t"), F.lit("river stone banks of"))).collect()]
    for t, g in zip(texts, got, strict=True):
        words = [(m.start(), m.end(), m[0] in ("river", "stones", "bank")) for m in re.finditer(r"\w+", t)]
        best = None
        for i, (a, _, hit) in enumerate(words):
            for j in range(i, min(i + 12, len(words))):
                if hit and words[j][2]:
                    n = sum(h for _, _, h in words[i : j + 1])
                    worth = 100 * n - 12 * (j - i + 1 - n)
                    if best is None or worth > best[0]:
                        best = (worth, a, words[j][1])
        assert (g and (g.start, g.stop)) == (best and best[1:])


def test_span_columns(spark):
    df = spark.createDataFrame([("the river bank", "river"), ("x", "y"), (None, None)], "t string, q string")
    got = [r[0] for r in df.select(span_of(F.col("t"), F.col("q"))).collect()]
    assert (got[0].start, got[0].stop) == (4, 9) and got[1] is None and got[2] is None
    assert value(spark, same_word(F.lit("garden"), F.lit("gardens"))) and not value(spark, same_word(F.lit("garden"), F.lit("garlic")))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(vector.normalize(F.col("v"))).collect()] == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0]]
    assert df.select(vector.l2(F.col("v"), [0.0, 0.0])).first()[0] == 5
    wide = spark.createDataFrame([([1.0] * 200,)], "v array<float>")
    assert wide.select(vector.squared_l2(F.col("v"), [0.0] * 200)).first()[0] == 200
    assert wide.select(vector.dot_constant(F.col("v"), [2.0] * 200)).first()[0] == 400


def test_embedders(spark):
    r = embed.Registry({"text": 32})
    a, b = r.encode("text", ["x", "y"]), r.encode("text", ["y"])
    assert np.allclose(np.linalg.norm(a, axis=1), 1, atol=1e-6) and (a[1] == b[0]).all() and r.encode("text", []).shape == (0, 32)
    with pytest.raises(ValueError):
        r.encode("text; drop", ["x"])
    r.register("text", 2, lambda t: np.ones((len(t), 2), np.float32))
    assert spark.range(1).select(r.column("text", F.lit("x"))).first()[0] == [1.0, 1.0]
    assert value(spark, embed.image_query(F.lit(" A Cat "))) == "a photo of a cat."


def test_thinning(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert value(spark, windows.thin_by_gap(arr(0, 1, 2, 2.5, 4), 2.0)) == [0, 2, 4]
    assert value(spark, windows.thin_evenly(arr(*range(10)), 4)) == [0, 2, 5, 7]
    assert value(spark, windows.pick_timestamps(arr(1), F.lit(10.0), 2.0, 12)) == [1, 3, 5, 7, 9]
    assert value(spark, windows.pick_timestamps(arr(5, 1, 2, 9), F.lit(10.0), 2.0, 12)) == [1, 5, 9]
    assert value(spark, windows.scene_times(F.lit("a pts_time:1.5 b\npts_time:20"))) == [1.5, 20]
    assert [tuple(r) for r in value(spark, windows.split_ranges(F.lit(10), F.array(F.lit(3), F.lit(7), F.lit(3))))] == [(0, 3), (3, 7), (7, 10)]


def test_heat_stands_out(spark):
    t = "plain words go on and on " * 6 + "bright shining star " + "plain words go on and on " * 6
    df = spark.createDataFrame([(1, t), (2, "too short"), (3, "same same same same same same same same")], "id long, text string")
    got = windows.word_heat(df, "id", "text", lambda w: F.when(w.contains("star"), 1.0).otherwise(0.0)).collect()
    assert {r.id for r in got} == {1}
    assert all(0 <= r.start < r.stop <= len(t) and 0 < r.value <= 1 for r in got)
    assert any("star" in t[r.start : r.stop] for r in got) and sum(r.stop - r.start for r in got) < len(t) / 3


def test_kinds(spark):
    f = lambda p: value(spark, files.kind_of(F.lit(p)))
    assert [f(p) for p in ("a.jpg", "b.MP4", "c.mp3", "d.md", "e.exe", "noext")] == ["image", "video", "audio", "text", None, None]


@pytest.mark.parametrize("t", ["", " ", "a", " a  b\n", "ab\tcd ef", "\U0001f600x é \U0001f600", "x " * 3000])
def test_places_of_words(spark, t):
    got = value(spark, windows.words_at(F.split(F.lit(t), "")))
    assert [(w.a, w.b) for w in got] == [m.span() for m in re.finditer(r"[^ \t\n\x0b\f\r]+", t)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_heat_of_a_text_in_several_batches_without_a_shuffle(spark):
    likeness = lambda w: text.trigram_overlap("the other thing", F.lower(w))
    df = spark.createDataFrame([(i, " ".join(f"{'the other' if k % 17 == i else 'plain'} w{k % 5}" for k in range(40 * i))) for i in range(6)], "id long, text string")
    whole = windows.word_heat(df, "id", "text", likeness)
    assert "Exchange" not in plan_of(whole)
    want = sorted(map(tuple, whole.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, windows.word_heat(df, "id", "text", likeness).collect())) == want and len({w[0] for w in want}) > 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_postings_are_counted_in_their_row(spark):
    texts = ["a b a", "", None, "b", "x_x  X ! ab", "a " * 500]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "chunk_id long, chunk_text string")
    made = S.postings(chunks)
    assert "Exchange" not in plan_of(made)
    want = {(t, i, n, len(own)) for i, own in enumerate(re.findall("[a-z]+", (t or "").lower()) for t in texts) for t, n in Counter(own).items()}
    assert sorted((r.token, r.chunk_id, r.tf, r.length) for r in made.collect()) == sorted(want)


def test_a_text_is_split_once_for_all_its_chunks(spark, sf):
    plan = plan_of(from_tables(spark, sf).chunks)
    assert plan.count("split(") == 1, plan


def test_few_texts_are_folded_at_a_time():
    texts = pa.array([None, *["Їжак " * 2000] * 2000])
    tracemalloc.start()
    got = text.fold.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].as_py() == "" and got[1].as_py() == " ".join(["ижак"] * 2000) and len(got) == 2001
    assert peak < 12e6
