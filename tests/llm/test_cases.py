"""Executors that come and go, hot and null keys, clashing helper names, chains of stages, and brute-force versions."""

from __future__ import annotations

import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from holdfast.llm import decontaminate, langid, license_scan, minhash, mixing, quality_gam, secrets, sharding, token_planes
from holdfast.llm.common import Scope
from holdfast.llm.queries import tokenizer_path
from holdfast.sources import scratch
from tests.llm.test_operators import BASE, EDGE, ITEM, SCHEMA, benchmark, changed, ids, labels, prose, write

R = random.Random(23)


def plain(spark, path, rows, files=1):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


# --- executors that come and go


@pytest.fixture
def shaky(spark, monkeypatch):
    """Every table that an operator writes changes how the next pass over its input is split."""
    write_table, n = scratch.write_table, [0]

    def changing(df, label):
        n[0] += 1
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str([3, 16, 5][n[0] % 3]))
        spark.conf.set("spark.sql.files.maxPartitionBytes", ["4k", "64m", "20k"][n[0] % 3])
        return write_table(df, label)

    monkeypatch.setattr(scratch, "write_table", changing)
    yield spark
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def survivors():
    rows = []
    for i in range(40):
        base = prose(80)
        rows += [(10 * i + j, base if j == 1 else changed(base, j), "en", f"s{i % 5}", 1) for j in range(3)]
        rows.append((10 * i + 5, prose(30) + (f" {ITEM}" if i % 4 == 0 else ""), "en", "t", 1))
    rows += [(None, "same text", "en", "u", 1)] * 60 + [(3, f"hot {i}", "en", "u", 1) for i in range(60)]
    return rows


@pytest.mark.parametrize("name", ["clean", "keep_one", "near", "sharded", "mixed", "mix_plan", "tokens"])
def test_results_do_not_depend_on_splits(shaky, tmp_path, name):
    rows = survivors()
    docs = plain(shaky, tmp_path / "docs", rows, 24)
    all_ids = ids(docs.collect())
    if name == "clean":
        got = ids(decontaminate.clean_documents(docs, benchmark(shaky, [(1, ITEM)])).collect())
        assert got == Counter(r[0] for r in rows if ITEM not in r[1])
    elif name == "keep_one":
        got = minhash.keep_one(docs).collect()
        stays = [r for r in minhash.near_duplicates(docs).collect() if r.stays]
        assert ids(got) == ids(stays) and len({r.text for r in got}) == len(got)
    elif name == "near":
        once = minhash.near_duplicates(docs.coalesce(1)).collect()
        again = minhash.near_duplicates(docs).collect()
        of = lambda rows: Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)
        assert of(once) == of(again) and ids(again) == all_ids
    elif name == "sharded":
        got = sharding.sharded(docs, shards=6).collect()
        slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(6)}
        sizes = [sum(len(r.text.encode()) + 8 for r in got if r.shard == s) for s in range(6)]
        assert ids(got) == all_ids and all(v == list(range(len(v))) for v in slots.values())
        assert max(sizes) - min(sizes) <= 2 * max(len(r[1].encode()) + 8 for r in rows)
    elif name == "mixed":
        plan = Counter()
        for r in mixing.mix_plan(docs).collect():
            plan[r.doc_id] += r.copies
        assert ids(mixing.mixed(docs).collect()) == Counter({k: n for k, n in plan.items() if n})
    elif name == "mix_plan":
        one, two = (sorted(map(repr, mixing.mix_plan(d).collect())) for d in (docs, docs.coalesce(1)))
        assert one == two
    else:
        got = token_planes.round_trip(docs, tokenizer_path()).collect()
        assert ids(got) == all_ids
        starts = sorted((r.start, r.n_tokens) for r in got)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


# --- hot and null keys


def test_coins_of_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, f"{i} " + prose(49), "en", f"s{i % 3}", 1) for i in range(1500)]
    got = mixing.mix_plan(plain(spark, tmp_path / "null", rows, 3)).collect()
    for target in {r.target for r in got}:
        assert sum(r.taken for r in got if r.target == target) == pytest.approx(target, rel=0.08)
    rows = [(7, "one text of five words", "en", f"s{i % 3}", 1) for i in range(1500)]
    got = mixing.mix_plan(plain(spark, tmp_path / "same", rows, 3)).collect()
    for target in {r.target for r in got}:
        assert sum(r.taken for r in got if r.target == target) == pytest.approx(target, rel=0.08)


def test_many_sources_are_filled_alike(spark, tmp_path):
    from tests.llm.test_operators import water_filling

    rows = [(i, prose(1 + i % 40), "en", None if i % 97 == 0 else f"s{i * i % 301:03d}", 1) for i in range(1200)]
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    docs = spark.createDataFrame(rows, SCHEMA).select("source", mixing.word_count(F.col("text")).alias("size"))
    got = {r.source: r.target for r in mixing.source_targets(Scope(spark), docs).collect()}
    assert got == {s: pytest.approx(t) for s, t in water_filling(sizes).items()}


@pytest.mark.parametrize("key", [None, 5])
def test_a_hot_id_is_written_to_several_files(spark, tmp_path, key):
    rows = [(key if i % 3 else i, f"text {i} " + prose(6), "en", "a", 1) for i in range(600)]
    docs, folder = plain(spark, tmp_path / "docs", rows, 4), f"file://{tmp_path}/planes"
    manifest = token_planes.write_tokens(docs, folder, tokenizer_path(), file_bytes=4000)
    assert manifest.count() > 12 and manifest.agg(F.max("n_docs")).first()[0] < 120
    got = sorted(token_planes.read_tokens(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    crc = Counter((r[0], zlib.crc32(np.array([*t.encode(r[1], add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == crc


def test_shards_of_null_keys(spark, tmp_path):
    from tests.llm.test_operators import check_shards

    rows = [(None if i % 3 else i, "x" * R.randrange(1, 90), "en", "a", 1) for i in range(3000)]
    got = sharding.shard_documents(plain(spark, tmp_path / "docs", rows, 5)).collect()
    assert len(got) == 3000
    check_shards(got, 24)


def test_hot_bands_and_stars(spark, tmp_path, monkeypatch):
    """Parts so small that bands and stars are dealt out, against brute force."""
    monkeypatch.setattr(minhash, "HOT", 3)
    monkeypatch.setattr(minhash, "STAR_ROWS", 4)
    monkeypatch.setattr(minhash, "BAND_ROWS_A_TASK", 5)
    from tests.llm.test_operators import check_near

    rows = []
    for _ in range(3):
        base = prose(120)
        rows += [(len(rows) + i, changed(base, 1 + i % 5), "en", "a", 1) for i in range(30)]
    check_near(plain(spark, tmp_path / "docs", rows, 3), rows)


def test_size_classes():
    c = lambda n, percent: math.floor(math.log(n) / (math.log(100 / percent) * (1 + 1e-9)))
    for percent in (80, 85):
        for n in range(1, 3000):
            most = n * 100 // percent
            assert c(most, percent) - c(n, percent) <= 1


# --- names that operators might use themselves


ODD = ["__row", "_row", "row", "__copies", "Copies", "__size", "SIZE", "__score", "__text", "ROW_ID", "_row_id", "digest", "gone", "_gone", "own", "KEY", "rate", "times", "repeat", "range", "Part", "salt", "finer", "sum", "at", "of", "first", "source_key"]


@pytest.mark.parametrize("stage", ["good", "one", "clean", "mixed", "sharded"])
def test_columns_with_names_of_helpers_stay(spark, tmp_path, stage):
    rows = [(i, f"{prose(20)} {i}", "en", f"s{i % 2}", 1) for i in range(20)] + EDGE
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(c).alias(c) for c in ODD]).write.parquet(path)
    docs = spark.read.parquet(path)
    got = {
        "good": lambda: quality_gam.keep_good(docs, labels(spark)),
        "one": lambda: minhash.keep_one(docs),
        "clean": lambda: decontaminate.clean_documents(docs, benchmark(spark, [(1, ITEM)])),
        "mixed": lambda: mixing.mixed(docs),
        "sharded": lambda: sharding.sharded(docs),
    }[stage]()
    assert [c for c in got.columns if c not in ("shard", "slot")] == docs.columns
    found = got.collect()
    assert found and all(r[c] == c for r in found for c in ODD)


# --- the stages as a chain


def folder(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, [(r[0], int(r[0] != 9), 0) for r in rows if r[0] is not None]).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark, [(1, ITEM), (2, None), (3, "")]).write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("rows", [EDGE, [], [(None, None, None, None, None)] * 5, [(1, BASE, "en", "a", 1)] * 40])
def test_stages_as_a_chain_on_odd_rows(spark, tmp_path, rows):
    made = len(scratch.MADE)
    got = P.run(spark, folder(spark, tmp_path, rows))
    assert set(got.columns) == {*[c.split()[0] for c in SCHEMA.split(", ")], "shard", "slot"}
    found = got.collect()
    assert set(ids(found)) <= {r[0] for r in rows}
    assert sorted(r.slot for r in found if r.shard == 0) == list(range(sum(r.shard == 0 for r in found)))
    assert len(scratch.MADE) == made + 1  # the result is all that stays in the shared folder


# --- licences


def test_copies_of_short_templates_are_found(spark, tmp_path):
    one = (license_scan.Template("mit", "MIT License"),)
    rows = [(i, "MIT License " * i, "en", "a", 1) for i in (1, 2, 5)] + [(9, "license mit", "en", "a", 1)]
    got = {r.doc_id: r for r in license_scan.scan(plain(spark, tmp_path / "docs", rows), one).collect()}
    assert {i: [(s.first, s.last) for s in got[i].spans] for i in (1, 2, 5, 9)} == {i: [(2 * j, 2 * j + 1) for j in range(i)] for i in (1, 2, 5)} | {9: []}


def test_lines_between_the_halves_of_a_span():
    lines = [(0, 3, 0, [0, 1, 2, 3]), (3, 4, 1, [2, 3]), (5, 9, 1, [4, 5, 6, 7, 8])]
    spans = license_scan.merged(lines, 3)
    assert [(s.first, s.last, sorted(s.covered)) for s in spans][0] == (0, 9, list(range(9)))


def test_more_templates_than_are_sent(spark, tmp_path, monkeypatch):
    rows = EDGE + [(22, "Licensed under the Apache License, Version 2.0.", "en", "a", 1)]
    docs = plain(spark, tmp_path / "docs", rows)
    want = sorted(map(repr, license_scan.digest(license_scan.scan(docs)).collect()))
    monkeypatch.setattr(license_scan, "SENT_POSITIONS", 0)
    assert sorted(map(repr, license_scan.digest(license_scan.scan(docs)).collect())) == want


# --- decontamination

LONG_ITEM = "Anna walked 12 km to Berlin in 3 hours and bought 5 apples for 20 euros before the market closed at noon that day and then she went home by train"


def verdicts(spark, path, texts, item=LONG_ITEM):
    docs = plain(spark, path, [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    return {r.doc_id: (r.verdict, r.coverage) for r in decontaminate.contaminated(docs, benchmark(spark, [(1, item)])).collect()}


def test_pieces_scattered_over_a_document_do_not_add_up(spark, tmp_path):
    words = LONG_ITEM.split()
    pieces = [" ".join(words[i : i + 6]) for i in range(0, len(words) - 5, 2)]
    scattered = "".join(f"{prose(40)} {p} " for p in pieces)
    put_in = " ".join([*words[:9], "very", "slowly", *words[9:19], "indeed", *words[19:]])
    left_out = " ".join(words[:13] + words[14:])
    got = verdicts(spark, tmp_path / "docs", [scattered, put_in, left_out, LONG_ITEM])
    assert got.keys() == {1, 2, 3} or got.keys() == {2, 3}
    assert got[3] == ("verbatim", 1.0)


def test_verdicts_come_from_slots(spark, tmp_path):
    item = "the farmer keeps many sheep and some goats in a field near the old river and sells exactly 5 of them each spring to a friend who lives over the hills"
    got = verdicts(spark, tmp_path / "docs", [item, item.replace(" 5 ", " 7 "), item.replace("goats", "cows")], item)
    assert {i: v for i, (v, _) in got.items()} == {0: "verbatim", 1: "reparameterised", 2: "verbatim"}


def test_slots_are_consistent_over_neighbouring_diagonals(spark, tmp_path):
    """The same number of the item becomes two numbers, one before and one after a word that was put in."""
    item = "take 40 red balls from the first big box and put them aside then take 40 red balls from the second big box and put them aside too"
    both = item.replace("40", "60")
    torn = "take 60 red balls from the first big box and put them aside well then take 70 red balls from the second big box and put them aside too"
    got = verdicts(spark, tmp_path / "docs", [both, torn], item)
    assert got.keys() == {0} and got[0][0] == "reparameterised"


def brute_force_contaminated(texts, items, shared_values=False):
    """All windows of all forms compared as tuples of tokens; lines, alignments, quantities and verdicts in plain loops."""
    units = set(decontaminate.UNITS.split())

    def forms(text):
        tokens, slots, starts, names_of, start = [], {}, {}, {}, True
        for t in re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]", text or ""):
            if t in ".!?\n":
                start = True
                continue
            if t[0].isdigit():
                slots[len(tokens)] = "<n>"
            elif slots.get(len(tokens) - 1) == "<n>" and t.lower() in units:
                slots[len(tokens)] = "<u>"
            elif t[0].isupper() and not t.isupper():
                (starts if start else slots)[len(tokens)] = "<p>"
            tokens.append(t.lower())
            start = False
        every = slots | starts
        for i, kind in every.items():
            near = {"<n>": i + 1, "<u>": i - 1, "<p>": -1}[kind]
            names_of[i] = (tokens[i], tokens[near] if 0 <= near < len(tokens) else None)
        return tokens, [{}, slots, every], names_of

    def settle(windows):
        seen, chosen = {}, {}
        for _, pairs in windows:
            for quantity, value in pairs:
                seen.setdefault(quantity, []).append(value)
        for quantity, values in seen.items():
            if quantity[1] is None and not quantity[0][0].isdigit() and len(set(values)) > 1:
                return 0, False
            most = max(values.count(v) for v in values)
            chosen[quantity] = sorted(v for v in values if values.count(v) == most)[0]
        same = all(quantity[0] == value for quantity, value in chosen.items())
        if not shared_values:
            chosen = {q: v for q, v in chosen.items() if not any(w == v and r[0] != q[0] for r, w in chosen.items())}
        good = set()
        for p, pairs in windows:
            if all(q in chosen and chosen[q] == v for q, v in pairs):
                good.add(p)
        return len(good), same

    out = {}
    for d, text in enumerate(texts):
        words, own, _ = forms(text)
        for n, item in enumerate(items):
            tokens, slots, quantity = forms(item)
            k, best, counts = min(5, len(tokens)), None, []
            for f in range(3):
                if not k or (f and len(slots[f]) == len(slots[f - 1])):
                    continue
                wanted = [p for p in range(len(tokens) - k + 1) if k - sum(i in slots[f] for i in range(p, p + k)) >= min(2, k)]
                shape = {p: [slots[f].get(i, tokens[i]) for i in range(p, p + k)] for p in wanted}
                lines = {}
                for q in range(len(words) - k + 1):
                    here = [own[f].get(i, words[i]) for i in range(q, q + k)]
                    for p in wanted:
                        if shape[p] == here:
                            lines.setdefault(q - p, []).append((p, [(quantity[p + i], words[q + i]) for i in range(k) if p + i in slots[f]]))
                groups = []
                for diagonal in sorted(lines):
                    places = {p for p, _ in lines[diagonal]}
                    low, high = min(places) + diagonal, max(places) + diagonal + k - 1
                    chosen, gain = None, 0
                    for g in groups:
                        near = diagonal - g["diagonal"] <= 3 and low - g["high"] <= 8 and g["low"] - high <= 8
                        if near and len(places - g["places"]) > gain:
                            chosen, gain = g, len(places - g["places"])
                    if chosen is None:
                        chosen = {"low": low, "high": high, "places": set(), "windows": []}
                        groups.append(chosen)
                    chosen.update(low=min(low, chosen["low"]), high=max(high, chosen["high"]), diagonal=diagonal)
                    chosen["places"] |= places
                    chosen["windows"] += lines[diagonal]
                found = [(good / len(wanted), same) for good, same in (settle(g["windows"]) for g in groups) if good >= 0.8 * len(wanted)]
                counts.append(len(found))
                best = max([*found, *([best] if best else [])], default=None)
            if best:
                out[d, n] = (best[0], "verbatim" if best[1] else "reparameterised", max(counts))
    return out


@pytest.mark.parametrize("shared_values", [False, True])
def test_decontamination_against_brute_force(spark, tmp_path, sf, shared_values):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()] + [ITEM, "two words", "Anna has 5 apples. Berta has 7 apples. How many in all?"]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()][:80]
    texts += [f"{prose(10)} {i} {prose(10)}" for i in items]
    texts += [re.sub(r"\d+", lambda m: str(int(m[0]) + 11), i).replace("Anna", "Maria").replace("Berta", "Olga") for i in items]
    texts += [changed(i, n) for i in items for n in (1, 2) if len(i.split()) > 5]
    # all numbers alike, and numbers that go by the place in the text
    texts += [re.sub(r"\d+", "6", i) for i in items] + [re.sub(r"\d+", lambda m: str(m.start() % 7), f"{i} {prose(3)} {i}") for i in items]
    got = decontaminate.contaminated(plain(spark, tmp_path / "docs", [(i, t, "en", "a", 1) for i, t in enumerate(texts)], 4), benchmark(spark, list(enumerate(items))), shared_values=shared_values).collect()
    assert {(r.doc_id, r.item_id): (r.coverage, r.verdict, r.n_places) for r in got} == brute_force_contaminated(texts, items, shared_values)
    assert len(got) > 2 * len(items)


def test_values_that_coincide(spark, tmp_path):
    fruit = "Anna has 5 apples and Berta has 7 pears which they bought at the old market this morning"
    trip = "A slow train goes 60 km in 60 minutes on its way from the old harbour to the new town"
    texts = [fruit.replace("5", "6").replace("7", "6"), trip.replace("60 km", "40 km").replace("60 min", "30 min"), fruit, trip]
    docs = plain(spark, tmp_path / "docs", [(i, t, "en", "a", 1) for i, t in enumerate(texts)])

    def found(shared_values):
        rows = decontaminate.contaminated(docs, benchmark(spark, [(1, fruit), (2, trip)]), shared_values=shared_values).collect()
        return {(r.doc_id, r.item_id): r.verdict for r in rows}

    always = {(1, 2): "reparameterised", (2, 1): "verbatim", (3, 2): "verbatim"}
    assert found(True) == always | {(0, 1): "reparameterised"}
    assert found(False) == always


def test_a_quantity_with_a_second_value_is_cut_out_of_a_long_question(spark, tmp_path):
    item = "they packed 40 red balls into the big box near the door and then walked along the river to the mill where the miller gave them bread and some milk before they packed 40 red balls again"
    texts = [item.replace("40", "60"), item.replace("40", "60", 1), item.replace("40", "60", 1).replace("40", "70")]
    got = verdicts(spark, tmp_path / "docs", texts, item)
    assert {i: v for i, (v, _) in got.items()} == {0: "reparameterised", 1: "verbatim", 2: "reparameterised"}
    assert got[0][1] == 1.0 and 0.8 <= got[2][1] < 1.0


def test_recall_of_reparameterised_items(spark, tmp_path, sf):
    """Items with quantities of their own among long texts; numbers are drawn from few values, so that they coincide, and names are others."""
    rng = random.Random(5)
    things = ["apples", "tickets", "bricks", "km", "minutes", "euros", "boxes", "hours"]
    items = []
    for i in range(60):
        rng.shuffle(things)
        a, b, c = (rng.choice([2, 5, 10, 60]) for _ in range(3))
        items.append(f"On the way to Berlin our friend {prose(6)} {a} {things[0]} for the {prose(4)} and {b} {things[1]} of it {prose(5)} after {c} {things[2]} how much is left {prose(3)}")
    again = [re.sub(r"\d+", lambda m: str(rng.choice([3, 4, 8, 90])), i).replace("Berlin", "Madrid") for i in items]
    texts = [f"{prose(60)} {t} {prose(60)}" for i, t in enumerate(again)] + [prose(200) for i in range(60)]
    docs = plain(spark, tmp_path / "docs", [(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark(spark, list(enumerate(items))), shared_values=True).collect()}
    assert got <= {(i, i) for i in range(60)} and len(got) >= 0.9 * 60


# --- language and quality


def test_texts_without_letters_are_undetermined(spark, tmp_path):
    rows = [(i, "das ist ein haus und der hund ist gross", "de", "a", 1) for i in range(40)]
    rows += [(100, "½ ² ³ ①", None, "a", 1), (101, "12 ٣ Ⅷ _ !", None, "a", 1), (102, "ein² haus½", None, "a", 1)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(plain(spark, tmp_path / "docs", rows)).collect()}
    assert got[100] == got[101] == ("und", 0.0) and got[102][0] == "de"


def test_small_languages_keep_their_words(spark, tmp_path):
    """Two short texts of a language beside thousands of words of others."""
    rows = [(i, prose(60), "en", "a", 1) for i in range(300)] + [(1000 + i, t, "xx", "a", 1) for i, t in enumerate(["qlop wazu mirtel", "qlop snuv", "wazu qlop"] * 3)]
    docs = plain(spark, tmp_path / "docs", rows + [(5000, "qlop wazu", None, "a", 1)])
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert got[5000] == "xx" and all(got[1000 + i] == "xx" for i in range(9))
    model = langid.train(docs, vocabulary=2)
    assert len(model.rows[0]) <= 4 and model.languages == ["en", "xx"]


@pytest.mark.parametrize("doc_id", [None, 3])
def test_rows_of_one_id_are_sampled_by_their_texts(spark, tmp_path, doc_id):
    """More rows without an id, or of one id, than a language's share: learnt from all the same."""
    texts = {"en": "the house is red and old", "de": "das haus ist rot und sehr alt", "fr": "la maison est rouge"}
    rows = [(doc_id, f"{t} {'abcdefgh'[i % 8]}{'xyz'[i % 3]} {t}", lang, "a", 1) for lang, t in texts.items() for i in range(300)]
    rows += [(doc_id, "el mismo texto otra vez", "es", "a", 1)] * 400
    docs = plain(spark, tmp_path / "d", rows, 3)
    model = langid.train(docs, per_language=12)
    assert model.languages == ["de", "en", "es", "fr"]
    scorer = langid.Scorer(model)
    got = [scorer.predict([t])[0][0] for _, t, *_ in rows]
    assert got == [r[2] for r in rows]


def test_what_a_worker_learns_serves_its_next_task(spark, tmp_path):
    """Tasks of one worker share the encoder and the lexicon."""
    path = tokenizer_path()

    def run(batches):
        import os

        for b in batches:
            encoder, lexicon = token_planes.encoder_of(path), decontaminate.lexicon_of_worker()
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "encoder": [id(encoder)], "known": [len(encoder.known)], "lexicon": [len(lexicon)]})
            encoder.encode(b.column(0).to_pylist())
            lexicon.numbers(b.column(0).to_pylist())

    docs = spark.range(12).selectExpr("concat('some words of row ', id) as text").repartition(1)
    for _ in range(3):
        seen = docs.mapInArrow(run, "pid long, encoder long, known long, lexicon long").collect()
    again = docs.repartition(12).mapInArrow(run, "pid long, encoder long, known long, lexicon long").collect()
    workers = {r.pid: r.encoder for r in seen + again}
    assert all(workers[r.pid] == r.encoder for r in seen + again)
    assert len(again) > len(workers) and any(r.known and r.lexicon for r in again)


def test_language_scores_against_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for r in docs.collect():
        words = re.findall(r"[a-zA-ZÀ-ɏ]+", r.text.lower())
        if not words:
            assert got[r.doc_id].lang_pred == "und"
            continue
        total = [0.0] * len(model.languages)
        for w in words:
            rows = [model.logs[0][model.rows[0][w]]] if w in model.rows[0] else []
            for k in (4, 3, 2, 1):
                marked = w if k == 1 else f"\x02{w}\x03"
                rows = rows or [model.logs[k][model.rows[k][g]] for g in (marked[i : i + k] for i in range(len(marked) - k + 1)) if g in model.rows[k]]
            for j in range(len(total)):
                total[j] += sum(x[j] for x in rows) / len(rows) if rows else 0.0
        best = max(total)
        p = [math.exp((t - best) / math.sqrt(len(words))) for t in total]
        assert got[r.doc_id].lang_pred == model.languages[total.index(best)]
        assert got[r.doc_id].score == pytest.approx(max(p) / sum(p))


def test_quality_scores_against_plain_loops(spark, sf):
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_gam.train(docs, marks)
    texts = {r.doc_id: r.text for r in docs.collect()}
    place = lambda edges, v: sum(e <= v for e in edges)
    for r in quality_gam.score_documents(docs, marks).collect():
        x = quality_gam.features(texts[r.doc_id])
        total = model.prior
        for edges, t, v in zip(model.edges, model.tables, x, strict=True):
            total += t[place(edges, v)]
        for i, j, t in model.pairs:
            total += t[place(model.coarse[i], x[i])][place(model.coarse[j], x[j])]
        assert r.score == pytest.approx(1 / (1 + math.exp(-total))) and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_repeated_ids_are_learnt_from_once(spark, tmp_path):
    rows = [(i % 50, prose(20), "en", "a", 1) for i in range(400)]
    docs, marks = plain(spark, tmp_path / "docs", rows, 7), labels(spark, [(i, i % 2, 0) for i in range(50)])
    one, two = quality_gam.train(docs, marks), quality_gam.train(docs.coalesce(1), marks)
    assert one.prior == two.prior and all((a == b).all() for a, b in zip(one.tables, two.tables, strict=True))


# --- token planes


def test_what_an_encoder_remembers_is_bounded_in_bytes():
    e = token_planes.Encoder(tokenizer_path())
    texts = ["".join(chr(R.randrange(0x4E00, 0x9FA5)) for _ in range(500)) for _ in range(60)]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e.encode(texts) == want
    assert len(e.known) < 10 and e.held < 10_000
    assert e.encode([prose(300)]) and 0 < e.held < 200_000


def test_collector_is_on_again_after_a_failed_task(tmp_path):
    import gc

    import pyarrow as pa

    bad = pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "doc_id": pa.array([1], pa.int64()), "text": pa.array(["x"])})
    with pytest.raises(Exception):  # noqa: B017
        list(token_planes._write(f"file://{tmp_path}/planes", "/no/such/tokenizer.json", "bit", 0)(iter([bad])))
    assert gc.isenabled()


# --- secrets

LOOKALIKES = """
Donaudampfschifffahrtsgesellschaft usr/local/share/applications/mimeinfo AbstractSingletonProxyFactoryBean getElementsByClassNameAndAttribute
com/example/project/service/impl/UserServiceImpl antidisestablishmentarianism Rechtsschutzversicherungsgesellschaften anticonstitutionnellement
electroencephalographically order_2024_000123456789 test_should_return_none_when_empty MAX_NUMBER_OF_RETRIES_EXCEEDED
var/lib/docker/overlay2/containers/config 1234567890123456789012345678 ISBN-978-3-16-148410-0-edition Uebermittlungsdatenbankverwaltung
internationalization-and-localization http2-server-push-implementation-notes kubernetes-dashboard-certificates-holder
/home/user/projects/repository/src/main/java/org/app 550e8400-e29b-41d4-a716-446655440000 onclick-handler-for-submit-button-disabled
ThisIsAVeryLongCamelCaseIdentifierName libgstreamer-plugins-base-dev nodejs-v18-x64-linux-binaries ------------------------ ________________________
aaaaaaaaaaaaaaaaaaaaaaaa 0000000000000000000000 pneumonoultramicroscopicsilicovolcanoconiosis
""".split()


def test_planted_keys_among_lookalikes(spark, tmp_path):
    """Keys that no pattern names, made otherwise than the samples the models are trained on."""
    kinds = [string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "-_"]
    keys = ["x" + "".join(R.choice(kinds[i % 4]) for _ in range(19 + i % 3 * 8)) for i in range(400)]
    rows = [(i, f"the value {k} stands here", "en", "a", 1) for i, k in enumerate(keys)]
    rows += [(1000 + i, f"the value {w} stands here", "en", "a", 1) for i, w in enumerate(LOOKALIKES)]
    got = {r.doc_id: [s for s in r.spans if s["rank"] == 3] for r in secrets.scan(plain(spark, tmp_path / "docs", rows, 2)).collect()}
    found = sum(any(s["start"] == 10 and s["stop"] == 10 + len(k) for s in got[i]) for i, k in enumerate(keys))
    alarms = [w for i, w in enumerate(LOOKALIKES) if got[1000 + i]]
    assert found >= 0.97 * len(keys) and not alarms


def test_places_of_very_many_matches(spark, tmp_path):
    text = "é token=abcdef1 " * 3000
    got = secrets.digest(secrets.scan(plain(spark, tmp_path / "docs", [(1, text, "en", "a", 1)]))).first()
    assert got.n_assign == 3000 and got.spans.split(",")[-1] == f"assign:{16 * 2999 + 2}:{16 * 2999 + 15}"


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_guards_hold_no_key_back(spark, tmp_path, n):
    from holdfast.llm.common import guard, without

    keys = spark.range(0, 3 * n, 3).toDF("gone")
    may = guard(keys)
    assert keys.where(~may(F.col("gone"))).count() == 0
    rows = spark.range(0, 3 * n + 3).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("k"))
    assert rows.where(may(F.col("k")) & (F.col("k") % 3 != 0)).count() <= 0.05 * (3 * n + 3)
    assert without(rows, "k", keys).count() == rows.count() - keys.where("gone % 7 <> 0").count()
