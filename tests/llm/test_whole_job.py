"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import random

import corpus_pipeline as P
from holdfast.llm import decontaminate
from tests.llm.test_operators import fold, write

R = random.Random(11)
WORDS = ["river", "stone", "light", "winter", "garden", "window", "paper", "music", "letter", "morning"]


def prose(n):
    return " ".join(f"{R.choice(WORDS)}{R.randrange(90)}" for _ in range(n))


def kept_by_brute_force(rows, percent):
    sets = []
    for _, t, *_ in rows:
        w = fold(t).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(least.values())


def test_near_duplicate_stage_at_80_percent(spark, tmp_path):
    """Copies of 150 words with 1 to 5 words apart from each other changed: 0.93, 0.87, 0.81, 0.76 and 0.71."""
    rows = []
    for _ in range(12):
        base = prose(150).split()
        rows.append((len(rows), " ".join(base), "en", "a", 1))
        for n in range(1, 6):
            copy = list(base)
            for i in range(n):
                copy[12 + 25 * i] = f"new{R.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy), "en", "a", 1))
    got = sorted(r.doc_id for r in P.drop_near_duplicates(spark, write(spark, tmp_path, rows), "").collect())
    assert got == kept_by_brute_force(rows, 80)
    assert got != kept_by_brute_force(rows, 85)


SOLD = "Natalia sold 48 clips in April. Natalia then bought 12 pens for 3 dollars each. How many clips are left now?"


def test_contamination_with_other_names_at_the_head_of_sentences(spark, tmp_path):
    other = SOLD.replace("48", "57").replace("12", "19").replace(" 3 ", " 7 ")
    same = other.replace("Natalia", "Maria")
    two = other.replace("Natalia", "Maria", 1).replace("Natalia", "Anna")
    rows = [(1, same, "en", "a", 1), (2, "Question: " + same, "en", "a", 1), (3, two, "en", "a", 1), (4, "Nothing of it. " + prose(40), "en", "a", 1), (5, "Some text. " + SOLD, "en", "a", 1)]
    items = spark.createDataFrame([(1, SOLD)], "item_id long, text string")
    df = write(spark, tmp_path, rows)
    got = {r.doc_id: r.verdict for r in decontaminate.contaminated(df, items).collect()}
    assert got == {1: "reparameterised", 2: "reparameterised", 5: "verbatim"}
    assert {r.doc_id for r in decontaminate.clean_documents(df, items).collect()} == {3, 4}
