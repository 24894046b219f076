"""Reading order by X-Y cuts against a recursive version, and pages whose order is known."""

import random

import pytest

from folioscore.operators import layout

pytestmark = pytest.mark.unit
SCHEMA = "doc_id string, page_no int, text string, left double, top double, right double, bottom double"


def plain(blocks, gap):
    """Recursive cuts; blocks are (text, left, top, right, bottom)."""

    def parts(rows, start, end, is_cut):
        rows = sorted(rows, key=lambda b: (b[start], b[end]))
        out, reach = [[rows[0]]], rows[0][end]
        for b in rows[1:]:
            if is_cut(b[start] - reach):
                out.append([])
            out[-1].append(b)
            reach = max(reach, b[end])
        return out

    def widest(rows, start, end):
        found = []
        parts(rows, start, end, lambda g: found.append(g))
        return max(found, default=-1)

    if len(blocks) < 2:
        return blocks
    if widest(blocks, 1, 3) >= gap:
        cut = parts(blocks, 1, 3, lambda g: g >= gap)
    elif (w := widest(blocks, 2, 4)) >= 0:
        cut = parts(blocks, 2, 4, lambda g: g >= w)
    else:
        return sorted(blocks, key=lambda b: (b[2], b[1], b[4], b[3]))
    return [b for part in cut for b in plain(part, gap)]


def order(spark, pages, gap=10.0):
    rows = [(d, 1, b[0], *map(float, b[1:])) for d, blocks in pages.items() for b in blocks]
    random.Random(0).shuffle(rows)
    got = layout.reading_order(spark.createDataFrame(rows, SCHEMA).repartition(3), gap).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["seq"])):
        out.setdefault(r["doc_id"], []).append(r["text"])
    return out


def test_known_pages(spark):
    two_columns = [
        ("title", 0, 0, 210, 20), ("l1", 0, 40, 100, 60), ("l2", 0, 70, 100, 90), ("l3", 0, 100, 100, 130),
        ("r1", 110, 40, 210, 60), ("r2", 110, 70, 210, 130), ("foot", 0, 160, 210, 170),
    ]
    side_note = [("note", 300, 0, 360, 500), ("a", 0, 0, 200, 20), ("b", 0, 30, 200, 50), ("c", 0, 60, 200, 80)]
    grid = [("1", 0, 0, 10, 10), ("3", 100, 0, 110, 10), ("2", 0, 50, 10, 60), ("4", 100, 50, 110, 60)]
    overlapping = [("b", 5, 5, 50, 50), ("a", 0, 0, 40, 40), ("c", 45, 48, 60, 60)]
    lines = [(f"{i:02}", 0, i * 20, 100, i * 20 + 20 - i % 3) for i in range(30)]
    got = order(spark, {"two": two_columns, "side": side_note, "grid": grid, "over": overlapping, "lines": lines, "one": [("x", 0, 0, 1, 1)]})
    assert got["two"] == ["title", "l1", "l2", "l3", "r1", "r2", "foot"]
    assert got["side"] == ["a", "b", "c", "note"]
    assert got["grid"] == ["1", "2", "3", "4"]
    assert got["over"] == ["a", "b", "c"] and got["one"] == ["x"]
    assert got["lines"] == [f"{i:02}" for i in range(30)]


def test_random_pages_equal_the_recursive_version(spark):
    rng, pages = random.Random(7), {}
    for d in range(60):
        blocks, taken = [], set()
        for i in range(rng.randrange(1, 15)):
            left, top = rng.randrange(0, 300, 7), rng.randrange(0, 300, 11)
            if (left, top) not in taken:  # no ties, which only the row's hash would settle
                taken.add((left, top))
                blocks.append((f"b{i}", float(left), float(top), left + rng.randrange(5, 90) + i / 100, top + rng.randrange(5, 40) + i / 100))
        pages[f"p{d}"] = blocks
    got = order(spark, pages)
    assert got == {d: [b[0] for b in plain(blocks, 10.0)] for d, blocks in pages.items()}


def test_odd_rows(spark):
    rows = [("d", 1, "x", 0.0, 0.0, 1.0, 1.0, 9), ("d", 1, "none", None, 0.0, 1.0, 1.0, 9), ("d", 1, None, 0.0, 5.0, 1.0, 6.0, 9)]
    df = spark.createDataFrame(rows * 2, SCHEMA + ", seq int")
    got = layout.reading_order(df).collect()
    assert sorted(r["seq"] for r in got) == [1, 2, 3, 4, 5, 6]
    assert [r["text"] for r in sorted(got, key=lambda r: r["seq"])] == ["x", "x", None, None, "none", "none"]
    assert layout.ordered_text(layout.reading_order(df)).first()["page_text"] == "x\n\nx\n\n\n\n\n\nnone\n\nnone"
    assert layout.reading_order(df.limit(0)).collect() == []


def test_one_shuffle_and_no_files_however_deep_a_page_is(spark):
    deep, x, y = [], 0, 0
    for i in range(40):  # a line, and to the right of a strip below it the next part
        deep.append((f"{i:02}", x, y, x + 2000, y + 10) if i % 2 == 0 else (f"{i:02}", x, y, x + 20, y + 2000))
        x, y = (x, y + 20) if i % 2 == 0 else (x + 40, y)
    deep = [(t, a, b, min(c, 2000), min(d, 2000)) for t, a, b, c, d in deep]
    assert order(spark, {"deep": deep, "one": [("x", 0, 0, 1, 1)]})["deep"] == [f"{i:02}" for i in range(40)]
    df = spark.createDataFrame([("d", 1, *deep[0][:1], *map(float, deep[0][1:]))], SCHEMA)
    plan = layout.reading_order(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "FileScan" not in plan
