"""Tables from ruling lines and words."""

import random

import pytest

from sparkloom.operators import ruled

LINES, WORDS = "source string, page int, x0 double, y0 double, x1 double, y1 double", "source string, page int, x0 double, top double, x1 double, bottom double, text string"


def found(spark, lines, words):
    rows = ruled.ruled_tables(spark.createDataFrame(lines, LINES), spark.createDataFrame(words, WORDS)).collect()
    return {(r["source"], r["page"], r["table"]): (r["bbox"], r["content"]) for r in rows}


def grid(source, page, xs, ys):
    return [(source, page, xs[0], y, xs[-1], y) for y in ys] + [(source, page, x, ys[0], x, ys[-1]) for x in xs]


def word(source, page, x, y, text):
    return (source, page, x, y, x + 5.0 * len(text), y + 8.0, text)


def test_grids_of_any_shape(spark):
    rng, lines, words, want = random.Random(5), [], [], {}
    for page in range(1, 5):
        top = 20.0
        for number in range(1, rng.randrange(2, 4)):
            xs = [30.0 + 90 * k for k in range(rng.randrange(2, 6))]
            ys = [top + 25 * k for k in range(rng.randrange(3, 7))]
            top = ys[-1] + 40
            lines += [(s, p, a + rng.uniform(-1, 1), b, c, d + rng.uniform(-1, 1)) for s, p, a, b, c, d in grid("f", page, xs, ys)] * rng.choice([1, 2])
            rows = []
            for y in ys[:-1]:
                rows.append([])
                for x in xs[:-1]:
                    cell = [f"w{rng.randrange(100)}" for _ in range(rng.randrange(1, 4))]
                    words += [word("f", page, x + 5 + 25 * k, y + 6 + rng.uniform(0, 1), t) for k, t in enumerate(cell)]
                    rows[-1].append(" ".join(cell))
            head, *rest = ("| " + " | ".join(r) + " |" for r in rows)
            want["f", page, number] = "\n".join([f"[TABLE {number} — Page {page}]", head, "|" + "---|" * len(rows[0]), *rest])
    rng.shuffle(lines)
    rng.shuffle(words)
    got = found(spark, lines, words)
    assert {k: v[1] for k, v in got.items()} == want
    assert all(abs(v[0][0] - 30) < 2 for v in got.values())


def test_spans_lines_in_cells_and_what_is_no_table(spark):
    lines = [("f", 1, 0, 0, 200, 0), ("f", 1, 0, 20, 200, 20), ("f", 1, 0, 60, 200, 60), ("f", 1, 0, 0, 0, 60), ("f", 1, 200, 0, 200, 60), ("f", 1, 100, 20, 100, 40), ("f", 1, 100, 40, 100, 60)]
    lines += [("f", 1, 300, 0, 300, 50), ("f", 1, 0, 100, 90, 100), ("f", 1, 0, 110, 90, 190), ("f", 1, None, 0, 1, 1), (None, 1, 0, 0, 9, 0)]
    lines += grid("f", 2, [0, 50, 100], [0, 20, 40]) + grid("g", 1, [0, 100], [0, 20, 40, 60])
    words = [word("f", 1, 5, 5, "Head"), word("f", 1, 130, 6, "wide"), word("f", 1, 5, 25, "one"), word("f", 1, 40, 25, "two"), word("f", 1, 5, 40, "below"), word("f", 1, 120, 30, "right"), word("f", 1, 350, 5, "outside")]
    words += [word("f", 2, 5, 5, "only"), word("f", 2, 55, 5, "row"), word("f", 2, 5, 25, "  "), word("g", 1, 5, 5, "a"), word("g", 1, 5, 45, "b"), word("g", 1, 5, 45, "b")]
    lines = [(s, p, *[None if v is None else float(v) for v in at]) for s, p, *at in lines]
    words = [(s, p, *map(float, at), text) for s, p, *at, text in words]
    assert found(spark, lines, words) == {
        ("f", 1, 1): ([0.0, 0.0, 200.0, 60.0], "[TABLE 1 — Page 1]\n| Head wide |  |\n|---|---|\n| one two\nbelow | right |"),
        ("g", 1, 1): ([0.0, 0.0, 100.0, 60.0], "[TABLE 1 — Page 1]\n| a |\n|---|\n| b b |"),
    }


@pytest.mark.parametrize("lines", [[], [("f", 1, 0.0, 0.0, 10.0, 0.0)]])
def test_no_tables(spark, lines):
    assert found(spark, lines, [word("f", 1, 1.0, 1.0, "x")]) == {} == found(spark, lines, [])
