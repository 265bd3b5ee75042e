"""Layout on pages made for the purpose, each operator against what the page shows."""

import random
from statistics import median

from pyspark.sql import functions as F

from claimloom.operators import assembly, blocks, layout
from claimloom.sources import pages as paged

SCHEMA = "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double, text string, size double, bold boolean"


def put(text, x, y, page=0, doc=1, size=10.0, bold=False):
    """A text's words from x on, six points a character."""
    out, at = [], float(x)
    for w in text.split(" "):
        out.append((doc, page, at, float(y), at + 6.0 * len(w), float(y) + size, w, size, bold))
        at += 6.0 * (len(w) + 1)
    return out


def cells(y, label, *values, at=(300, 380, 460), **k):
    return put(label, 40, y, **k) + [w for x, v in zip(at, values, strict=False) for w in put(v, x, y, **k)]


def frame(spark, words, width=612.0, height=792.0):
    df = spark.createDataFrame(words, SCHEMA)
    return df, paged.dimensions(df, width, height)


def grid(y=200, **k):
    return (
        put("Harvest by farm and season in tonnes", 40, y, **k) + [w for x, h in ((300, "Spring"), (380, "Summer")) for w in put(h, x, y + 16, **k)]
        + put("Cereals and pulses", 40, y + 32, **k) + cells(y + 48, "Barley (1)", "41.5", "17.2", **k) + cells(y + 64, "Rye", "8.", "9", **k) + cells(y + 80, "Oats", "12", "(3.5)", **k)
    )


def test_lines_columns_and_boxes(spark):
    ws = cells(100, "Wheat", "7.6", "9.2") + cells(121, "Maize", "1.2", "2.4", bold=True) + put("(1)", 200, 100) + put("(1)", 200, 121)
    df, _ = frame(spark, ws)
    got = sorted(layout.lines_of(df).collect(), key=lambda r: r.line_no)
    assert [r.text for r in got] == ["Wheat (1) 7.6 9.2", "Maize (1) 1.2 2.4"] and [r.bold for r in got] == [False, True]
    nums = df.where(blocks.numeric_token(F.col("text"))).select("doc_id", "page_no", "text", ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.lit(612.0).alias("width"))
    assert sorted((r.n, r.centre) for r in layout.columns_of(nums).collect()) == [(2, 309.0), (2, 389.0)]
    boxes = df.select(F.lit(7).alias("fact_id"), "x0", "y0", "x1", "y1")
    assert sorted((r.x0, r.y0, r.x1) for r in layout.merged_boxes(boxes).collect()) == [(40.0, 100.0, 398.0), (40.0, 121.0, 398.0)]
    assert layout.lines_of(df.limit(0)).count() == 0


def test_lines_against_plain_banding(spark):
    r = random.Random(3)
    ws = [w for k in range(40) for w in put("ab cd", r.uniform(0, 500), 30 + 15 * (k % 20) + r.uniform(-2, 2), page=k // 20)]
    got = {}
    for x in layout.lines_of(spark.createDataFrame(ws, SCHEMA)).collect():
        got.setdefault(x.page_no, []).append((x.line_no, round(x.mid, 6), len(x.words)))
    for page, rows in got.items():
        own = sorted((w for w in ws if w[1] == page), key=lambda w: ((w[3] + w[5]) / 2, w[2]))
        lines = []
        for w in own:
            m = (w[3] + w[5]) / 2
            for line in lines[: -4 : -1]:
                if abs(median(line) - m) <= 6.0:
                    line.append(m)
                    break
            else:
                lines.append([m])
        want = sorted((round(median(x), 6), len(x)) for x in lines)
        assert sorted((b, c) for _, b, c in rows) == want


def test_table(spark):
    df, dims = frame(spark, put("Some words before it all", 40, 100) + put("and more of the sort that goes on for as long as a line of prose may go on", 40, 150) + grid())
    lines = layout.lines_of(df)
    regions = layout.table_regions(lines)
    assert [(r.first, r.last) for r in regions.collect()] == [(2, 7)]
    t = layout.tables_of(lines, regions, dims).first()
    assert t.caption == "Harvest by farm and season in tonnes"
    assert [(r.section, r.label, [(c.header, c.value) for c in r.cells]) for r in t.rows] == [
        (True, "Cereals and pulses", []), (False, "Barley (1)", [("Spring", "41.5"), ("Summer", "17.2")]), (False, "Rye", [("Spring", "8."), ("Summer", "9")]), (False, "Oats", [("Spring", "12"), ("Summer", "(3.5)")]),
    ]
    crowded = grid() + [w for y in (248, 264, 280) for w in put("77 88", 296, y + 1)]
    df, dims = frame(spark, crowded)
    lines = layout.lines_of(df)
    assert layout.tables_of(lines, layout.table_regions(lines), dims).where(F.exists("rows", lambda r: F.exists(r["cells"], lambda c: c["value"].contains(" ")))).count() == 0


def test_number_parted_in_two_and_labels_that_wrap():
    words = lambda ws: [dict(x0=a, y0=0.0, x1=a + 12, y1=10.0, text=t) for a, t in ws]
    rows = [words([(300, "A"), (380, "B")]), words([(40, "Rent"), (295, "456."), (303, "1"), (380, "2")]), words([(300, "3"), (380, "4")]), words([(40, "Wages"), (300, "5"), (380, "6")])]
    caption, got = layout.table_of(rows, 612.0)
    assert caption == "" and [(r["label"], [(c["header"], c["value"]) for c in r["cells"]]) for r in got] == [
        ("Rent", [("A", "456.1"), ("B", "2")]), ("Rent", [("A", "3"), ("B", "4")]), ("Wages", [("A", "5"), ("B", "6")])]
    assert layout.table_of([words([(10, "no"), (40, "numbers")])] * 3, 612.0) is None


def test_regions_against_a_plain_scan(spark):
    r = random.Random(9)
    words, kinds = [], {}
    for page in range(30):
        kinds[page] = [r.choice("nnnsl") for _ in range(r.randint(1, 30))]
        for i, k in enumerate(kinds[page]):
            words += put({"n": "12 34", "s": "a few words", "l": " ".join(["word"] * 13)}[k], 40, 20 + 20 * i, page=page)
    got = sorted((x.page_no, x.first, x.last) for x in layout.table_regions(layout.lines_of(spark.createDataFrame(words, SCHEMA))).collect())
    want = []
    for page, ks in kinds.items():
        rows = [i for i, k in enumerate(ks) if k == "n"]
        islands = []
        for i in rows:
            if islands and i - islands[-1][-1] <= 2:
                islands[-1].append(i)
            else:
                islands.append([i])
        for own in islands:
            if own[-1] - own[0] >= 2:
                top = own[0]
                while top > 0 and own[0] - top < 5 and ks[top - 1] != "l":
                    top -= 1
                want.append((page, top, own[-1]))
    assert got == sorted(want)


def test_two_columns(spark):
    ws = [w for i in range(9) for w in put("left hand words of it", 40, 60 + 14 * i) + put("right hand words of it", 330, 60 + 14 * i, page=0)]
    ws = [(*w[:3], w[3] + (7 if w[2] >= 330 else 0), w[4], w[5] + (7 if w[2] >= 330 else 0), *w[6:]) for w in ws]
    df, dims = frame(spark, ws)
    lines = layout.lines_of(df)
    assert not any("left" in r.text and "right" in r.text for r in lines.collect())
    split = layout.gutters(lines, dims).first().split
    assert 160 < split < 330
    one, dims = frame(spark, [w for i in range(9) for w in put("words that go all the way from one side of the page to its other side", 40, 60 + 14 * i)])
    assert layout.gutters(layout.lines_of(one), dims).count() == 0


def test_tiles_keep_figures_with_captions(spark):
    ws = put("The year in three figures as this slide shows them to all of us who came", 30, 20)
    for x, figure, text in ((40, "12 Mt", "grain sold"), (300, "7 Mt", "straw kept"), (560, "3 Mt", "seed saved")):
        ws += put(figure, x, 100) + put(text, x - 15, 120)
    df, dims = frame(spark, ws, width=720.0, height=400.0)
    got = sorted((r.tile, r.nth, r.text) for r in layout.tiles(layout.lines_of(df), dims).collect())
    assert [t for _, _, t in got] == ["The year in three figures as this slide shows them to all of us who came", "12 Mt", "grain sold", "7 Mt", "straw kept", "3 Mt", "seed saved"]
    out = assembly.build_blocks(df, dims).collect()
    assert len(out) == 1 and out[0].slide and out[0].text.split("\n\n")[1:] == ["12 Mt\ngrain sold", "7 Mt\nstraw kept", "3 Mt\nseed saved"]


def test_paragraphs(spark):
    full = "words that fill the line of a column from side to side so that it goes"
    ws = put(f"{full} pro-", 40, 100) + put(f"duction {full}", 40, 112) + put(full, 40, 150) + put("(a) an item", 40, 162) + put(full, 40, 174)
    lines = layout.lines_of(spark.createDataFrame(ws, SCHEMA)).withColumn("col_width", F.lit(500.0))
    got = [r.text for r in layout.paragraphs(lines, ["doc_id", "page_no"]).orderBy("para").collect()]
    assert got == [f"{full} pro-duction {full}", full, "(a) an item", full]


def test_headings_and_sections(spark):
    rows = [("Soil and water", 14.0, False), ("4.2 Mt of grain", 14.0, False), ("Results of the trial", 10.0, True), ("It ends with a comma,", 14.0, False), ("NOTES ON METHOD", 10.0, False), ("plain text", 10.0, False), ("1. Barley", 12.0, False), ("ab", 20.0, True)]
    df = spark.createDataFrame(rows, "text string, size double, bold boolean")
    h = layout.heading(F.col("text"), F.lit(40.0), F.lit(200.0), F.col("size"), F.col("bold"), F.lit(10.0), F.lit(500.0))
    assert [r.h for r in df.select(h.alias("h")).collect()] == [True, False, True, False, True, False, True, False]
    hs = spark.createDataFrame([(1, 0, 16.0, "A"), (1, 1, 12.0, "B"), (1, 2, 11.0, "C"), (1, 3, 10.5, "D"), (1, 4, 12.0, "E"), (1, 5, 0.0, None), (1, 6, 9.0, "F"), (2, 0, 9.0, "X")], "doc_id long, nth long, size double, text string")
    got = [r.path for r in layout.sections(hs).orderBy("doc_id", "nth").collect()]
    assert got == ["A", "A > B", "A > B > C", "B > C > D", "E", "", "F", "X"]


def test_blocks_of_a_document(spark):
    words = []
    for page in range(5):
        words += put("Farm report 2031", 40, 20, page=page) + put(str(page + 11), 300, 770, page=page)
        words += put("Of the harvest", 40, 120, page=page, size=14.0) + put("In this year 40 farms had sold all of their barley by the end of May and more", 40, 150, page=page)
        words += put("(1) Without the farms that closed", 40, 700, page=page, size=8.0)
    words += grid(300, page=2)
    df, dims = frame(spark, words)
    dims = dims.withColumn("body_size", F.lit(10.0))
    got = sorted(assembly.build_blocks(df, dims).collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in got] == list(range(6)) and [(r.page_no, r.kind) for r in got] == [(0, "paragraph"), (1, "paragraph"), (2, "table"), (2, "paragraph"), (3, "paragraph"), (4, "paragraph")]
    assert {r.section for r in got} == {"Of the harvest"} and {r.label for r in got} == {"11", "12", "13", "14", "15"}
    assert all(r.notes == ["(1) Without the farms that closed"] and r.skip == "" for r in got)
    assert all(r.text.startswith("In this year 40 farms") and "Farm report" not in r.text for r in got if r.kind == "paragraph")
    assert got[2].text.splitlines()[:3] == ["Harvest by farm and season in tonnes", "[Cereals and pulses]", "Barley (1): Spring=41.5; Summer=17.2"]
    assert assembly.build_blocks(df.limit(0), dims.limit(0)).count() == 0


def test_table_chunks_repeat_their_banner(spark):
    row = lambda label, n: (False, label, [("H" * 10, "9" * n)])
    rows = [(True, "Acres", []), row("a", 700), row("b", 700), row("c", 700), (True, "Tonnes", []), (True, "alone", [])]
    plain = spark.createDataFrame([(rows[:4],)], "rows array<struct<section: boolean, label: string, cells: array<struct<header: string, value: string>>>>")
    assert [[r.label for r in c] for c in plain.select(blocks.chunked_rows(F.col("rows")).alias("c")).first().c] == [["Acres", "a", "b"], ["Acres", "c"]]
    df = spark.createDataFrame([(rows,)], "rows array<struct<section: boolean, label: string, cells: array<struct<header: string, value: string>>>>")
    got = df.select(blocks.chunked_rows(F.col("rows")).alias("c")).first().c
    assert [[r.label for r in c] for c in got] == [["Acres", "a", "b"], ["c", "Tonnes", "alone"]]
    r = random.Random(4)
    for _ in range(200):
        sizes, banners = [r.randint(1, 60) for _ in range(r.randint(0, 20))], []
        banners = [r.random() < 0.3 for _ in sizes]
        got = blocks._table_slices(sizes, banners, 100)
        assert all(sum(sizes[a : a + n]) <= 100 or n == 1 for a, n, _ in got)
        covered = [i for a, n, _ in got for i in range(a, a + n)]
        assert covered == sorted(set(covered)) and {i for i, b in enumerate(banners) if not b} <= set(covered)
        for a, n, h in got:
            before = [i for i in range(a) if banners[i]]
            inner = any(banners[a : a + n])
            assert h == (-1 if inner or not before else before[-1])


def test_prompt_and_density(spark):
    df = spark.createDataFrame([("Soil", "text", ["n1", "n2"]), (None, None, None)], "s string, t string, n array<string>")
    assert [r.p for r in df.select(blocks.prompt_text(F.col("s"), F.col("t"), F.col("n")).alias("p")).collect()] == ["[Section: Soil]\ntext\n[Footnote on same page: n1]\n[Footnote on same page: n2]", ""]
    df, dims = frame(spark, put("x", 10, 10) + put("many words on a page " * 30, 10, 10, page=1))
    assert [r.page_no for r in layout.scanned(df, dims).collect()] == [0]


def test_evidence_is_located(spark):
    words = put("In this year 40 farms had sold all of their barley", 40, 100) + put("by the end of May", 40, 114) + cells(200, "Rye", "18,074", "9.2") + put("nothing more", 40, 300)
    df, _ = frame(spark, words)
    box = {"x0": 0.0, "y0": 290.0, "x1": 612.0, "y1": 320.0}
    rows = [(1, "had sold all of their barley by the end of May", "40", None), (2, "Rye: Autumn sales = 18074 in all", "18074", None), (3, "no such thing anywhere at all", "77", None), (4, "not here at all", "77", box), (5, "", "more", box), (6, None, None, None)]
    facts = spark.createDataFrame([(i, 1, 0, q, v, b) for i, q, v, b in rows], "fact_id long, doc_id long, page_no int, quote string, value string, block struct<x0: double, y0: double, x1: double, y1: double>")
    got = {r.fact_id: (r.how, [tuple(x) for x in r.rects]) for r in layout.located(facts, df).collect()}
    assert got[1][0] == "quote" and [y for _, y, _, _ in got[1][1]] == [100.0, 114.0]
    assert got[2] == ("value", [(300.0, 200.0, 336.0, 210.0)]) and got[3] == ("none", []) and got[4] == ("block", [(0.0, 290.0, 612.0, 320.0)])
    assert got[5][0] == "value" and got[6] == ("none", [])
    hit = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (15.0, 0.0, 20.0, 9.0)), ((0.0, 0.0, 10.0, 10.0), (17.0, 0.0, 20.0, 9.0)), ((0.0, 0.0, 1.0, 1.0), None)], "a struct<x0: double, y0: double, x1: double, y1: double>, b struct<x0: double, y0: double, x1: double, y1: double>")
    assert [r.h for r in hit.select(layout.inside(F.col("a"), F.col("b")).alias("h")).collect()] == [True, False, True]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_folded_many_at_a_time(spark):
    """Batches that end within pages, pages with middles that are close or equal, null keys, and no group for each page."""
    rng = random.Random(5)
    ws = [w for page in range(40) for i in range(30) for w in put(f"w{i} x", rng.randrange(500), 40 + 16 * (i // 2) + (rng.random() * 5 if page % 3 == 0 else 0), page % 7, page // 7)]
    ws += put("no page", 10, 10, None, 900) + put("no document", 10, 10, 0, None)
    df, dims = frame(spark, ws)
    whole = {(r.doc_id, r.page_no, r.line_no): r for r in layout.lines_of(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {(r.doc_id, r.page_no, r.line_no): r for r in layout.lines_of(df).collect()} == whole
        boxes = df.where("doc_id IS NOT NULL AND page_no IS NOT NULL").selectExpr("doc_id * 100 + page_no AS fact_id", "x0", "y0", "x1", "y1")
        got = sorted(tuple(r) for r in layout.merged_boxes(boxes).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for w in ws:
        if w[0] is not None and w[1] is not None:
            by.setdefault(w[0] * 100 + w[1], []).append(w[2:6])
    assert got == sorted((f, n, *b) for f, x in by.items() for n, b in enumerate(layout.barred(x), 1))
    assert whole[900, None, 0].text == "no page" and whole[None, 0, 0].text == "no document"
    for own in (layout.lines_of(df), layout.merged_boxes(boxes), layout.sections(df.selectExpr("doc_id", "1 AS nth", "size", "text"))):
        assert "FlatMapGroups" not in plan(own)
    assert "words" not in layout.lines_of(df, keep_words=False).columns


def test_body_size_is_the_upper_median(spark):
    rows = [(1, 0, s) for s in (8.0, 9.0, 9.0, 12.0, None)] + [(1, 1, None)] + [(1, 2, s) for s in (8.0, 9.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, size double")
    assert {r.page_no: r.body_size for r in paged.dimensions(df).collect()} == {0: 9.0, 1: 10.0, 2: 9.0}
    assert "collect_list(size#" not in plan(paged.dimensions(df))


def test_texts_are_dealt_before_they_are_laid(spark):
    one = spark.createDataFrame([(i, "a  b\n\nc") for i in range(50)], "doc_id long, text string").coalesce(1)
    got = paged.text_words(one)
    assert "Exchange" in plan(got) and sorted((r.x0, r.y0, r.text) for r in got.where("doc_id = 3").collect()) == [(12.0, 36.0, "a"), (12.0, 64.0, "c"), (30.0, 36.0, "b")]


def _grid_of(rows, head=("Ash", "Birch")):
    line = lambda label, a, b: [{"x0": x, "y0": 0.0, "x1": x + 6.0 * len(t), "y1": 10.0, "text": t} for x, t in ((40.0, label), (300.0, a), (420.0, b))]
    return [line("-", *head)[1:], *(line(*r) for r in rows)]


def test_figures_of_four_digits_are_no_head():
    got = layout.table_of(_grid_of([("one", "4512", "3300."), ("two", "14512", "13300."), ("three", "4600", "2900")]), 612.0)
    assert [(r["label"], [c["header"] for c in r["cells"]]) for r in got[1]] == [(x, ["Ash", "Birch"]) for x in ("one", "two", "three")]
    got = layout.table_of(_grid_of([("one", "1999", "2001."), ("two", "1998", "2002."), ("three", "2003", "2004")]), 612.0)
    assert [r["label"] for r in got[1]] == ["one", "two", "three"]
    got = layout.table_of(_grid_of([("one", "451", "330"), ("two", "452", "331")], head=("2019", "2020")), 612.0)
    assert [[c["header"] for c in r["cells"]] for r in got[1]] == [["2019", "2020"]] * 2


def test_quote_is_found_where_it_stands_in_one_line():
    word = lambda y, k: [{"x0": 10.0 * i, "y0": y, "x1": 10.0 * i + 6, "y1": y + 10, "text": "a"} for i in range(k)]
    how, boxes = layout.located_in("a a a", "", word(10.0, 1) + word(30.0, 1) + word(50.0, 1) + word(70.0, 3), None)
    assert how == "quote" and [b[1] for b in boxes] == [70.0]


def test_pages_stay_dealt_when_facts_are_few(spark):
    df, _ = frame(spark, put("one two three", 10, 10))
    facts = spark.createDataFrame([(1, 1, 0, "one two three", "", None)], "fact_id long, doc_id long, page_no int, quote string, value string, block struct<x0: double, y0: double, x1: double, y1: double>")
    got = layout.located(facts, df)
    assert got.first().how == "quote" and "BroadcastHashJoin" not in plan(got)


def test_pages_of_blocks_are_read_once(spark):
    df, dims = frame(spark, grid())
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert assembly.build_blocks(df, dims.coalesce(1).mapInArrow(run, dims.schema)).count() == 1
    assert seen.value == 1
    lines = layout.lines_of(df)
    assert "FlatMapGroups" not in plan(layout.tables_of(lines, layout.table_regions(lines), dims))
