"""License scans: planted notices, edited notices, and the alignment against a plain one."""

import random

import numpy as np

from skyframe.llm.licenses import BAND, GRAM, TEMPLATES, WINDOW, Index, align, scan, scan_licenses, winnowed, words_of


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + 1 if x == y else 0, new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_alignment_finds_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(3, 14))]
        b = [rng.randrange(6) for _ in range(rng.randrange(1, 14))]
        matched, first, last = align(np.array(a), np.array(b), 0, 20)
        assert matched == longest_common(a, b)
        assert matched == 0 or longest_common(a, b[first:last + 1]) == matched


def test_winnowing_keeps_one_of_every_window():
    words = words_of(TEMPLATES["MIT"])
    kept = winnowed(words)
    assert all(any(i <= k < i + WINDOW for k in kept) for i in range(len(words) - GRAM - WINDOW + 2)) and len(kept) < len(words)
    assert winnowed(["a", "b"]) == [] and winnowed(["a", "b", "c"]) == [0]


def test_planted_and_edited_notices():
    rng, index = random.Random(2), Index.of(TEMPLATES)
    filler = [" ".join(rng.choice(["under", "the", "of", "software", "grün", "x9", "license", "this"]) for _ in range(200)) for _ in range(3)]
    for name, text in TEMPLATES.items():
        document = f"{filler[0]}. É {text.upper()}! {filler[1]} {text}"
        got = [r for r in scan(document, index) if r[0] == name]
        assert len(got) == 2 and all(r[3] == 1.0 for r in got)
        places = [(document.index(text.upper()), text.upper()), (document.rindex(text), text)]
        for r, (at, whole) in zip(got, places):
            core = whole.strip(" .)\"!")
            assert r[4] == at and document[r[4]:r[5]].split() == core.split()
        words = text.split()
        if len(words) > 30:
            edited = [w for i, w in enumerate(words) if i % 12 != 5]
            edited[20:20] = ["some", "added", "words"]
            hit = [r for r in scan(f"{filler[2]} {' '.join(edited)} {filler[0]}", index) if r[0] == name]
            assert len(hit) == 1 and 0.8 <= hit[0][3] < 1
            half = " ".join(words[: len(words) // 2])
            assert [r for r in scan(half, index) if r[0] == name] == []


def test_clean_texts():
    index = Index.of(TEMPLATES)
    for text in (None, "", "   ", "the software is under a license of this kind", "licensed under the", "the " * 30_000):
        assert scan(text, index) == []


def test_every_place_is_found_by_a_slower_search():
    """Windows of the template's length at every place, compared by their common subsequence."""
    rng, index = random.Random(4), Index.of({"t": "alpha beta gamma delta epsilon zeta eta theta iota kappa"})
    base = words_of("alpha beta gamma delta epsilon zeta eta theta iota kappa")
    for _ in range(60):
        words = [rng.choice(["alpha", "kappa", "noise", "more"]) for _ in range(40)]
        edited = list(base)
        for _ in range(rng.randrange(0, 4)):
            edited[rng.randrange(len(edited))] = "edit"
        words[15:15] = edited
        kept = any(edited[i:i + GRAM + WINDOW - 1] == base[i:i + GRAM + WINDOW - 1] for i in range(len(base)) if i + GRAM + WINDOW - 1 <= len(base))
        best = max(longest_common(base, words[i:i + 10]) for i in range(len(words)))
        got = scan(" ".join(words), index)
        if kept and best >= 8:
            assert got and got[0][1] >= best
        assert all(r[1] >= 8 and longest_common(base, words_of(" ".join(words)[r[4]:r[5]])) == r[1] for r in got)
    assert BAND >= 8


def test_frame(spark):
    text = "x. Released under the MIT License. y"
    rows = [(1, text, "l", 0), (1, text, "l", 0), (None, text, None, None), (2, None, "m", 1), (3, "", "n", 2), (4, "q " * 30_000 + text, "o", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, start int")
    got = sorted(scan_licenses(docs).collect(), key=lambda r: r["doc_id"] or 0)
    assert [(r["doc_id"], r["license"], r["start"], r["end"]) for r in got] == [(None, "MIT notice", 3, 33), (1, "MIT notice", 3, 33), (1, "MIT notice", 3, 33),
                                                                               (4, "MIT notice", 60_003, 60_033)]
    assert scan_licenses(docs.limit(0)).count() == 0


def test_notices_on_consecutive_lines():
    index = Index.of(TEMPLATES)
    for name, text in TEMPLATES.items():
        for n in (2, 3, 7):
            lines = f"start {text} " + "\n".join([text] * (n - 1)) + " end"
            got = [r for r in scan(lines, index) if r[0] == name]
            assert len(got) == n and all(r[3] == 1.0 for r in got), (name, n, got)
            assert all(a[5] <= b[4] for a, b in zip(got, got[1:]))
    listed = "".join(f"file{i}.py: Released under the MIT License.\n" for i in range(40))
    assert len([r for r in scan(listed, index) if r[0] == "MIT notice"]) == 40
