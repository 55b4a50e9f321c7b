"""Quality rules, the prefix trie and resampling against plain loops, on whole tables and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from holdfast.llm import prefix_trie, quality_rules, target_resampling
from holdfast.llm.queries import queries
from tests.llm.test_operators import EDGE, benchmark, fold, ids, write

R = random.Random(31)
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- quality rules


def plain_counts(text):
    text = text or ""
    words = BLANK.findall(text)
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}),
    }


def test_counts_against_plain_loops(spark, tmp_path):
    loop = " ".join(f"w{i}" for i in range(9))
    rows = [(i, t, "en", "a", 1) for i, t in enumerate([
        loop, f"{loop} {loop}", f"{loop} x {loop} y w0 w1 w2 w3 w4 w5 w6 w7", "Der " * 8, "Der " * 9, "a\tb\x0bc\x0cd\r\ne", "\n\nx\n x\nx\n\t\nx", "#$%  &|<>*", "ß ü 漢字     🙂",
        "\n".join(["the same line of words"] * 40), " ".join(R.choice("ab") for _ in range(3000)),
    ])]
    for r in quality_rules.digest(write(spark, tmp_path, rows + EDGE)).collect():
        texts = [t for i, t, *_ in rows + EDGE if i == r.doc_id]
        assert any(all(r[c] == v for c, v in plain_counts(t).items()) for t in texts), r
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.broken == "") and not (r.kept and r.base_failed)


def test_junk_goes_and_prose_stays(spark, sf):
    got = quality_rules.digest(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert not [r.doc_id for r in got if r.quality == 0 and r.kept]
    assert not [r.doc_id for r in got if r.quality == 1 and not r.kept and not r.base_failed]


def test_thresholds_are_a_table(spark, tmp_path):
    docs = write(spark, tmp_path, [(i, f"{'word ' * i}!", "en", "a", 1) for i in range(4)])
    rules = (quality_rules.Rule("few", "n_words", None, 3, None), quality_rules.Rule("loud", "n_marks", "n_words", None, 40))
    rows, names = quality_rules.judged(docs, rules=rules)
    assert {r.doc_id: r[names["broken"]] for r in rows.collect()} == {0: ["few", "loud"], 1: ["few", "loud"], 2: [], 3: []}
    kept = quality_rules.kept_documents(docs, rules=rules)
    assert kept.columns == docs.columns and ids(kept.collect()) == Counter([2, 3])
    assert quality_rules.kept_documents(docs, rules=()).count() == 4
    with pytest.raises(ValueError, match="unknown count"):
        quality_rules.judged(docs, rules=(quality_rules.Rule("x", "nothing", None, 1, None),))


def test_rules_are_one_projection(spark, sf):
    plan = quality_rules.digest(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# --- prefix trie


def plain_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    convs = own
    if rebuild:
        convs = {c: own.get(c - int(math.fmod(c, 20)), [])[: zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4 :] for c, v in own.items()}
    nodes = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in kids[p]) or 1
        saved[p] = sum(saved[x] for x in kids[p]) + ((len(nodes[p]) - 1) * len(BLANK.findall(p[-1][1])) if p else 0)
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


CONVERSATION = "conv_id long, turn long, role string, text string, part string, rep string, len string, words string"


def conversations(spark, tmp_path, rows):
    path = str(tmp_path / "conversations")
    spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], CONVERSATION).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def check_trie(spark, tmp_path, rows, rebuild=True):
    run = prefix_trie.rebuilt_trie if rebuild else prefix_trie.conversation_trie
    got = run(conversations(spark, tmp_path, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows, rebuild)


def test_trie_of_odd_conversations(spark, tmp_path):
    rows = [(c, t, R.choice(["user", "assistant"]), R.choice(["yes", "no thanks", ""])) for c in range(60) for t in range(R.randrange(1, 9)) if c % 7]
    rows += [(None, 0, "user", "no conversation"), (None, None, None, None), (5, None, None, None), (5, None, "user", "tie"), (5, 2, "user", "tie"), (5, 2, "user", "tie")]
    rows += [(-7, 1, "user", "below"), (-7, 0, None, "zero"), (-20, 3, "x:y", "1:"), (-20, 3, "x", "y:1:"), (1 << 62, 0, "user", "large")]
    check_trie(spark, tmp_path, rows)


@pytest.mark.parametrize("n", [1, 3, 37])
def test_trie_of_long_and_equal_conversations(spark, tmp_path, n):
    same = [(c, t, "user", f"turn {t % 3}") for c in (20, 21, 25, 29, 41, 49) for t in range(n)]
    check_trie(spark, tmp_path, same + [(30, t, "user", "other words") for t in range(n + 1)], rebuild=False)


def test_hot_conversations_and_turns(spark, tmp_path):
    """A third of the turns are one conversation's, a third of the conversations are alike."""
    rows = [(3, t, "user", f"turn {t % 5}") for t in range(900)] + [(100 + c, t, "user", f"turn {t}") for c in range(300) for t in range(2)]
    rows += [(1000 + c, t, "user", f"{c} {t}") for c in range(150) for t in range(2)]
    check_trie(spark, tmp_path, rows)


@pytest.mark.parametrize("rows_a_batch", [1, 2, 50])
def test_ends_are_hashed_piece_by_piece(monkeypatch, rows_a_batch):
    """Nodes and pieces end anywhere in a batch."""
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    ends = {(0, 0): [5], (0, 2): list(range(7)), (1, 1): [1, 10, 100], (1, 2): [-3, 2, 4, 8]}
    rows = [(*node, conv) for node, convs in ends.items() for conv in convs]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names=["rep", "depth", "conv"])
    pieces = list(prefix_trie._pieces(batch(rows[i : i + rows_a_batch]) for i in range(0, len(rows), rows_a_batch)))
    assert len(pieces) == 1 + 3 + 1 + 2
    found = {(r["rep"], r["depth"]): r["ends_sha256"] for b in prefix_trie._hashed(iter(pieces)) for r in b.to_pylist()}
    assert found == {node: hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest() for node, convs in ends.items()}


def test_empty_trie(spark, tmp_path):
    assert prefix_trie.rebuilt_trie(conversations(spark, tmp_path, [])).collect() == []
    assert prefix_trie.conversation_trie(conversations(spark, tmp_path, [(None, 1, "user", "x")])).collect() == []


# --- resampling


def plain_features(text):
    w = WORD.findall(fold(text))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resampling(docs, target):
    found = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in found:
        s.update(f)
    for x in target:
        t.update(plain_features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for i, words, f in found:
        u = (int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


TARGET = ["The river, the stone and the light of winter.", None, "", "ÄÖ ü ß漢字 mixed0words9"]


def test_resampling_against_plain_loops(spark, tmp_path):
    words = ["river", "stone", "Light", "winter", "ß", "漢字", "x9", "a_b", "it's"]
    rows = [(i, " ".join(R.choice(words) for _ in range(R.randrange(60))), "en", "a", 1) for i in range(-150, 300)]
    rows += [(7, rows[3][1], "en", "a", 1)] * 3 + [(None, "word " * 30, "en", "a", 1)] * 2 + EDGE
    docs, target = write(spark, tmp_path, rows), benchmark(spark, list(enumerate(TARGET)))
    assert sorted(map(tuple, target_resampling.resample_plan(docs, target).collect()), key=repr) == plain_resampling([(r[0], r[1]) for r in rows], TARGET)
    drawn = target_resampling.resampled(docs, target)
    assert drawn.columns == [*[c for c in docs.columns if c != "rank"], "rank"]
    assert sorted(r.rank for r in drawn.collect()) == [*range(1, drawn.count() + 1)]


@pytest.mark.parametrize("digit", [1, 3, 12])
def test_kth_key_for_every_k(spark, digit):
    rows = [(R.choice([-(1 << 63), -5, -5, 0, 3, (1 << 63) - 1]), R.randrange(-2, 2), i) for i in range(40)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (1, 2, 7, 20, 39, 40):
        first = df.where(target_resampling.kth_key(df, ["a", "b", "c"], k, digit)).collect()
        assert sorted(map(tuple, first)) == sorted(rows)[:k]


def test_features_of_slices_and_borders():
    """Words end with their text, batches may be slices, and texts may be empty."""
    texts = ["ab", "cd ef", None, "", "gh ", " ij", "K" * 3000 + " l", "é é é é"]
    for lo in range(len(texts)):
        for hi in range(lo, len(texts) + 1):
            at, owner, words = target_resampling.features(pa.array(texts, pa.string())[lo:hi])
            for i, t in enumerate(texts[lo:hi]):
                n, want = plain_features(t)
                assert words[i] == n and sorted(at[owner == i]) == sorted(want)


def test_resampling_of_nothing(spark, tmp_path):
    empty = write(spark, tmp_path, [], "none")
    assert target_resampling.resample_plan(empty, benchmark(spark)).collect() == []
    assert target_resampling.resampled(empty, benchmark(spark)).collect() == []
    few = write(spark, tmp_path, [(1, "word " * 30, "en", "a", 1)], "few")
    assert [r["rank"] for r in target_resampling.resample_plan(few, benchmark(spark)).collect()] == [None]


def test_all_thirteen_are_registered():
    assert [int(re.match(r"op(\d+)_", name)[1]) for name in queries()] == [*range(1, 14)]
