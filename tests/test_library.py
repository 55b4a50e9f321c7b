"""Search, library operations, stores, files and streams."""

from __future__ import annotations

import os
from datetime import date

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions.embed import Registry
from holdfast.operators import library as ops
from holdfast.operators import search as S
from holdfast.plans import ingest, search
from holdfast.queries import QUERIES, SQL, _vectors
from holdfast.sources import files, scratch, store
from holdfast.sources.library import from_tables
from holdfast.sources.settings import Settings
from holdfast.streaming import jobs as stream


@pytest.fixture(scope="module")
def lib(spark, sf):
    return from_tables(spark, sf)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, item_id long, space string, frame_id long, chunk_ix int, ts_s double, embedding array<float>")


def test_nearest_order_and_restriction(spark):
    e = vectors(spark, [(1, 1, "text", None, 0, None, [0.0, 0.0]), (2, 2, "text", None, 0, None, [1.0, 1.0]), (3, 3, "text", None, 0, None, [1.0])])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = lambda r=None: [x.item_id for x in S.nearest(e, "text", [0.0, 0.0], 5, r).collect()]
    assert got() == [1, 2] and got(ids(2)) == [2] and got(ids()) == []


def test_image_ensemble_fills_in_and_keeps_null_frames(spark):
    e = vectors(spark, [(1, 1, "image_a", None, None, None, [1.0, 0.0]), (2, 1, "image_b", None, None, None, [0.0, 1.0]), (3, 2, "image_a", 7, None, 3.0, [0.6, 0.8]), (4, 2, "image_b", 7, None, 3.0, [1.0, 0.0]), (5, 3, "image_a", None, None, None, [0.0, 1.0])])
    c = spark.createDataFrame([("image_a", 0.0, 1.0), ("image_b", 0.0, 1.0)], "space string, mean double, stddev double")
    got = {r.item_id: r for r in S.image_evidence(e, {"image_a": [1.0, 0.0], "image_b": [1.0, 0.0]}, c, 1).collect()}
    # k = 1 finds item 1 in one space and item 2 in the other; both are filled in
    assert got.keys() == {1, 2} and got[1].n_spaces == got[2].n_spaces == 2
    assert got[1].frame_id is None and (got[2].frame_id, got[2].ts_s) == (7, 3.0)
    assert got[2].score > got[1].score


def test_fusion_prefers_earlier_sources_on_ties(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "item_id long, score double")
    got = {r.item_id: r.source for r in S.fuse({"image": rows((1, 90.0), (2, 10.0)), "text": rows((1, 90.0), (2, 20.0), (3, 5.0)), "phrase": rows((2, 20.0), (3, 99.0))}, []).collect()}
    assert got == {1: "image", 2: "text", 3: "phrase"}


def test_filters(lib):
    assert S.allowed(lib.items, lib.tags, lib.item_tags, S.Filters("x")) is None
    f = S.Filters("", ["text"], ["src1"], date(2024, 1, 2), date(2024, 1, 3))
    got = {r.id for r in S.allowed(lib.items, lib.tags, lib.item_tags, f).collect()}
    rows = lib.items.select("id", "kind", "source", F.to_date("created_at").alias("d")).collect()
    assert got == {r.id for r in rows if r.kind == "text" and r.source == "src1" and date(2024, 1, 2) <= r.d <= date(2024, 1, 3)}
    assert S.allowed(lib.items, lib.tags, lib.item_tags, S.Filters("", [], ["no such tag"])).count() == 0
    with pytest.raises(ValueError):
        S.Filters("", ["song"])


def test_hybrid_search_ranks_and_an_empty_query_has_no_hits(spark, lib):
    v = _vectors(lib)
    word = lib.chunks.orderBy("chunk_id").first()["chunk_text"].split()
    phrase = " ".join(word[20:28])
    got = search.hybrid(lib, S.Filters(phrase), v).collect()
    scores = [r.score for r in got]
    assert scores == sorted(scores, reverse=True) and len({r.item_id for r in got}) == len(got)
    top = next(r for r in got if r.source == "phrase")
    assert top.phrase_ratio > 0.95 and top.score >= 99
    assert search.hybrid(lib, S.Filters("  "), v).count() == 0
    exact = search.hybrid(lib, S.Filters(f'"{phrase}"'), {}).collect()
    assert exact and all(phrase.lower() in " ".join(lib.items.where(F.col("id") == r.item_id).first()["body"].lower().split()) for r in exact)


def test_calibration_by_decoy_queries(spark):
    rows = [(i, i, "text", None, 0, None, [1.0, float(i)]) for i in range(6)] + [(9, 9, "image_a", None, None, None, [1.0])]
    e = vectors(spark, rows)
    got = {r.space: r for r in S.calibration(e, {"text": [[1.0, 0.0], [0.0, 1.0]], "image_a": [[2.0], [2.0]], "image_b": [[1.0]]}, sample=4).collect()}
    found = np.array([1, 1, 1, 1, 0, 1, 2, 3], float)
    assert got.keys() == {"text"}  # one space has no spread, one no vectors
    assert (got["text"].mean, got["text"].stddev, got["text"].sample_n, got["text"].population) == (pytest.approx(found.mean()), pytest.approx(found.std()), 8, 6)
    assert S.calibration(e, {"text": [[1.0, 0.0]]}, least=7).count() == 0
    decoys = search.decoys(Registry({"image_a": 8, "image_b": 8, "text": 8}))
    assert {len(v) for v in decoys.values()} == {len(search.DECOYS)} and set(decoys) == {"image_a", "image_b", "text"}


def test_tokens_joined_by_an_underscore_follow_each_other(spark):
    chunks = spark.createDataFrame([(1, "call foo_bar now"), (2, "foo and bar"), (3, "bar foo"), (4, "foo bar")], "chunk_id long, chunk_text string")
    assert {r.chunk_id for r in S.bm25(chunks, "foo_bar").collect()} == {1, 4}
    assert S.needs_order("foo_bar") and not S.needs_order("foo _bar_")


def test_settings(tmp_path, spark):
    path = tmp_path / "a" / "settings.json"
    s = Settings(str(path))
    assert s.values["asr_model"] == "large-v3-turbo" and s.values["theme"] == "dark"
    s.update({"asr_model": "small", "theme": "light", "data_dir": "elsewhere", "device": None})
    assert Settings(str(path)).values["asr_model"] == "small" and "data_dir" not in path.read_text()
    for bad in ({"device": "quantum"}, {"asr_model": "gigantic"}, {"snippet_words": 0}, {"download_dir": str(tmp_path / "none")}):
        with pytest.raises(ValueError):
            s.update({"theme": "dark", **bad})
    assert Settings(str(path)).values["theme"] == "light"
    s.update({"download_dir": str(tmp_path)})
    assert s.download_dir == tmp_path
    s.update({"download_dir": ""})
    assert s.values["download_dir"] == "" and s.download_dir.is_dir()
    path.write_text('{"theme": "pink", "snippet_words": 7}')
    assert Settings(str(path)).values["snippet_words"] == 7 and Settings(str(path)).refused.keys() == {"theme"}
    for broken in ("{ no json", "[1]"):
        path.write_text(broken)
        assert Settings(str(path)).values["theme"] == "dark"
    assert {r.key for r in s.rows(spark).collect()} == set(s.values)


def test_originals_are_stored_once_and_exported(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "one.JPG").write_bytes(b"picture")
    (d / "same.jpg").write_bytes(b"picture")
    (d / "note.mp3").write_bytes(b"sound")
    good, _ = files.scan(spark, str(d))
    root = f"file://{tmp_path}/library"
    got = files.store_originals(good, root).collect()
    assert len(got) == 2 and all(r.copied and r.error is None for r in got)
    assert not any(r.copied for r in files.store_originals(good, root).collect())
    items = spark.createDataFrame([(i, "My: label", r.target) for i, r in enumerate(sorted(got, key=lambda r: r.target))] + [(7, "gone", "originals/xx/none.mp3")], "id long, label string, stored_path string")
    out = files.export_originals(items, root, f"file://{tmp_path}/out").collect()
    assert sum(r.copied for r in out) == 2 and [bool(r.error) for r in out if "none" in r.source] == [True]
    assert sorted(f.read_bytes() for f in (tmp_path / "out").iterdir()) == [b"picture", b"sound"]


def test_sizes_are_looked_up_again_after_a_time(spark, tmp_path):
    now = [0.0]
    (tmp_path / "a").write_bytes(b"123")
    sizes = files.Sizes(spark, 60, lambda: now[0])
    assert sizes.of(str(tmp_path)) == 3
    (tmp_path / "b").write_bytes(b"45")
    now[0] = 59
    assert sizes.of(str(tmp_path)) == 3
    now[0] = 60
    assert sizes.of(str(tmp_path)) == 5


def test_a_warm_search_takes_few_jobs(spark, lib):
    """Five jobs of its own; what Spark adds to one (broadcasts, stages it plans anew) counts as its jobs too."""
    ready = search.cached(lib)
    v, query = _vectors(ready), S.Filters("the other thing of this")
    search.hybrid(ready, query, v).collect()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("warm", "warm")
    before = len(tracker.getJobIdsForGroup(None))
    search.hybrid(ready, query, v).collect()
    spark.sparkContext.setJobGroup("none", "none")
    assert len(tracker.getJobIdsForGroup(None)) + len(tracker.getJobIdsForGroup("warm")) - before <= 24


def test_calibration_is_stale_after_growth():
    assert S.stale(None, 10) and not S.stale({"population": 1000}, 1400) and S.stale({"population": 1000}, 1600)


def test_tags(spark, lib):
    assert {r.name: r.n_items for r in ops.tag_usage(lib.tags, lib.item_tags).collect()}["unused"] == 0
    with pytest.raises(FileExistsError):
        ops.create_tag(lib.tags, "src1")
    with pytest.raises(ValueError):
        ops.create_tag(lib.tags, " ")
    with pytest.raises(FileExistsError):
        ops.rename_tag(lib.tags, "src1", "src2")
    more = ops.create_tag(lib.tags, " New ")
    bridge = ops.set_tags(more, lib.item_tags, 3, ["New", "missing"])
    assert [r.tag_id for r in bridge.where("item_id = 3").collect()] == ["New"]
    assert ops.add_tag(bridge, "New", spark.createDataFrame([(3,)], "id long")).count() == bridge.count()


def test_patches(lib):
    items = lib.items.where("id in (1, 2)")
    got = {r.id: r for r in ops.patch_item(items, 1, "Fresh", "new words").collect()}
    assert (got[1].label, got[1].transcript, got[1].transcript_edited) == ("Fresh", "new words", True)
    same = got[2].transcript
    assert not ops.patch_item(items, 2, "", same).where("id = 2").first()["transcript_edited"]
    with pytest.raises(ValueError):
        store.update_rows(items, F.lit(True), nothing=1)


#: Blank, of the vertical tab (no white space in SQL) and of all other white space.
ODD_TEXTS = ["", " ", "\t\n \r\f", "\x0b", "a\x0bb", "\x0b a b c d e f g h\x0b", "a\x0bb c d e f g h i", "\n a  b\tc\nd\re\ff g h i ", "a b c d e f g h ", None]


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """The test tables with odd documents after the others, one without an id."""
    folder = tmp_path_factory.mktemp("odd")
    for name in os.listdir(sf):
        if name != "documents.parquet":
            os.symlink(f"{sf}/{name}", folder / name)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = spark.createDataFrame([(1000 + i, t, "en", "src1", len(t or "")) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", "en", "src1", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    documents.unionByName(rows).coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def both(spark, folder: str, name: str) -> tuple[list, list]:
    """The rows of a query and of its SQL, sorted."""
    con = duckdb.connect()
    for table in ("documents", "labels", "conversations"):
        path = f"{folder}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    mine = QUERIES[name](spark, folder)
    theirs = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({SQL[name]})").fetchall()
    return sorted(map(tuple, mine.collect()), key=repr), sorted(theirs, key=repr)


@pytest.mark.parametrize("name", ["patch_item", "upsert_items", "snippets_and_labels", "chunk_text"])
def test_odd_texts_as_in_sql(spark, odd, name):
    mine, theirs = both(spark, odd, name)
    assert mine == theirs


def test_job_states(spark):
    rows = [("running", None), ("failed", "bad"), ("failed", ops.NO_AUDIO), ("done", None), ("queued", None), ("failed", None)]
    df = spark.createDataFrame(rows, "s string, e string")
    assert [r[0] for r in df.select(ops.item_status(F.col("s"), F.col("e"))).collect()] == ["processing", "failed", "ready", "ready", "pending", "failed"]
    assert spark.range(1).select(ops.friendly_error(F.lit("CUDA out of memory: 2 GB"))).first()[0] == ops.FRIENDLY_MEMORY


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert {tuple(r) for r in store.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {r.k for r in store.insert_ignore(old, new, ["k"]).collect()} == {1, 2, 3} and store.insert_ignore(old, new, ["k"]).count() == 3


def test_store_versions_snapshots_and_migrations(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.read() == {}
    rows = spark.createDataFrame([(1, "text"), (2, "image")], "id int, space string")
    s.write({"t": rows}, "one")
    names = [s.snapshot(f"20240101-00000000{i}", "daily", keep=3) for i in range(5)]
    assert s.snapshots() == names[2:]
    s.write({"t": rows.where("id = 1")}, "two")
    assert s.read()["t"].count() == 1
    with pytest.raises(KeyError):
        s.request_restore("library-nothing")
    s.request_restore(names[-1])
    s.cancel_restore()
    assert s.apply_restore() is None
    s.request_restore(names[-1])
    assert s.apply_restore() == names[-1] and s.read()["t"].count() == 2 and s.read("two")["t"].count() == 1
    assert s.migrate({2: lambda t: {"t": t["t"].where("space <> 'image'")}}, "20240102-000000000") == 2
    assert s.read()["t"].count() == 1 and s.schema_version == 2

    def broken(_):
        raise OSError("disk")

    with pytest.raises(OSError):
        s.migrate({3: broken}, "20240103-000000000")
    assert s.schema_version == 2 and s.read()["t"].count() == 1
    s._note("schema_version", "9")
    with pytest.raises(RuntimeError):
        s.migrate({2: lambda t: t}, "20240104-000000000")


def test_files(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "note.txt").write_bytes(b"hello \xff world")
    (d / "copy.md").write_bytes(b"hello")
    (d / "tool.exe").write_bytes(b"x")
    good, bad = files.scan(spark, str(d))
    rows = {r.label: r for r in good.collect()}
    assert rows["note"].text_content == "hello � world" and rows["copy"].size_bytes == 5
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["tool.exe"]
    assert files.directory_size(spark, str(d)) == 19
    (tmp_path / "pairs.txt").write_text("# comment\na cat | cat.jpg\nno pair\n b | c | d\n")
    assert [tuple(r) for r in files.query_pairs(spark, str(tmp_path / "pairs.txt")).collect()] == [("a cat", "cat.jpg"), ("b", "c | d")]
    probe = '{"format": {"duration": "12.5", "tags": {"creation_time": "2024-05-06T07:08:09.000000Z"}}, "streams": [{"codec_type": "audio"}, {"codec_type": "video", "width": 640, "height": 480}]}'
    m = spark.range(1).select(files.media_metadata(F.lit(probe)).alias("m")).first().m
    assert (m.duration_s, m.width, m.height) == (12.5, 640, 480) and m.created_at is not None
    notes = files.prepare_texts(spark.createDataFrame([("  a note  ",), ("   ",)], "text string")).collect()
    assert [(n.text_content, n.size_bytes) for n in notes] == [("a note", 6)]
    files.export_notes(spark.createDataFrame([("a/b", "text one")], "label string, text_content string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "text one"


def test_ingest(spark, lib):
    new = spark.createDataFrame([(1, "h1"), (2, "h1"), (3, "h2"), (4, None), (5, None)], "id long, content_hash string")
    old = spark.createDataFrame([(9, "h2")], "id long, content_hash string")
    assert {r.id: r.duplicate for r in ingest.deduplicated(new, old).collect()} == {1: False, 2: True, 3: True, 4: False, 5: False}
    items = spark.createDataFrame([(1, "w " * 70, None, False), (2, "edited words", None, True), (3, None, "a note", None)], "id long, transcript string, text_content string, transcript_edited boolean")
    segments = spark.createDataFrame([(1, 0, 0.0, "w " * 40), (1, 1, 5.0, "w " * 30), (2, 0, 3.0, "old words")], "item_id long, ix int, start double, text string")
    got = {(r.item_id, r.chunk_ix): r.ts_s for r in ingest.transcript_chunks(items, segments).collect()}
    assert got == {(1, 0): 0.0, (2, 0): None, (3, 0): None}
    e = ingest.embedded(ingest.transcript_chunks(items, segments), Registry({"text": 16})).collect()
    assert all(len(r.embedding) == 16 for r in e)
    label = ingest.relabelled(F.lit("rec_01"), F.lit("/x/rec_01.mp3"), F.lit("first words of the recording"))
    assert spark.range(1).select(label).first()[0] == "first words of the recording"
    assert not spark.range(1).select(ingest.needs_recognition(F.lit(True), F.lit("kept"))).first()[0]


def test_synthetic_library(spark):
    for shape, kinds in (("mixed", {"image", "video", "text"}), ("media", {"video", "audio"})):
        items, e = files.synthetic(spark, 30, 8, shape)
        assert {r.kind for r in items.collect()} == kinds
        assert e.where(F.abs(F.expr("aggregate(embedding, 0D, (t, x) -> t + x * x)") - 1) > 1e-5).count() == 0
    with pytest.raises(ValueError):
        files.synthetic(spark, 1, shape="other")


def test_streams(spark, sf):
    e = stream.event_stream(spark, f"{sf}/events.parquet")
    n = e.select("event_type", "ts", "user_id", "event_id")
    s = stream.run_once(stream.states(n.select("event_id", "ts", F.col("user_id").alias("item_id"), F.lit("queued").alias("status"))), "update", ["item_id"])
    assert s.agg(F.sum("n_events")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
    assert {r.status for r in s.collect()} == {"queued"}
    assert stream.run_once(stream.sessions(n, "1 day"), "append").count() > 0


def test_job_recovery(spark):
    df = spark.createDataFrame([(1, "running"), (2, "done")], "id int, status string")
    assert {r.id: r.status for r in stream.recovered(df).collect()} == {1: "queued", 2: "done"}


def test_every_query_is_registered_once():
    assert len(QUERIES) >= 60


def test_scratch_tables_can_be_cleared(spark):
    df = scratch.materialise(spark.range(3).toDF("id"), "three")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 3 and os.path.exists(path)
    before, scratch.MADE[:] = scratch.MADE[:-1], scratch.MADE[-1:]
    scratch.clear_scratch(spark)
    assert not os.path.exists(path)
    scratch.MADE[:] = before
