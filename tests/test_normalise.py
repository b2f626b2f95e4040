"""Page normalisation on literal pages."""

from quireflow.operators import normalise

LINES = "document_id string, page_index int, block_id string, text string, x double, y double, w double, h double, confidence double"


def line(page, name, text, x, y, w, h=12.0, conf=0.9, doc="d"):
    return (doc, page, name, text, float(x), float(y), float(w), float(h), conf)


def by_block(spark, rows):
    got = normalise.units(spark.createDataFrame(rows, LINES)).collect()
    return {b: r for r in got for b in r.blocks}, got


def test_book_with_running_heads_columns_heading_and_notes(spark):
    rows = []
    for p in range(8):
        rows += [line(p, f"h{p}", "The Running Head", 200, 780, 120), line(p, f"n{p}", str(p + 10), 290, 20, 14)]
        # two columns: the left is read to its end before the right begins
        for k in range(4):
            rows.append(line(p, f"l{p}{k}", f"left {'abcdefgh'[p] * 3} {'wxyz'[k] * 3} goes on to the very edge{'.' if k == 3 else ''}", 60, 700 - 14 * k, 220))
            rows.append(line(p, f"r{p}{k}", f"right {'abcdefgh'[p] * 3} {'wxyz'[k] * 3} goes on to the very edge{'.' if k == 3 else ''}", 320, 700 - 14 * k, 220))
    units, got = by_block(spark, rows)
    assert {units[f"h{p}"].rule for p in range(8)} == {"remove_repeated_header"}
    assert {units[f"n{p}"].rule for p in range(8)} == {"remove_repeated_footer"}
    assert all(units[f"h{p}"].disposition == "never" and units[f"h{p}"].unit_no is None for p in range(8))
    assert units["l00"].blocks == ["l00", "l01", "l02", "l03"] and units["r00"].blocks == ["r00", "r01", "r02", "r03"]
    assert units["l00"].unit_no < units["r00"].unit_no
    assert len({r.unit_id for r in got}) == len(got)


def test_heading_note_contents_and_low_confidence(spark):
    rows = [
        line(0, "t", "Chapter of Salt", 60, 760, 200, h=20),
        *[line(0, f"b{k}", f"body line number {k} reaches the edge of the page{'1.' if k == 2 else ''}", 60, 700 - 14 * k, 400) for k in range(3)],
        line(0, "c", "Preface .... 12", 60, 560, 400),
        line(0, "u", "smudged words", 60, 480, 400, conf=0.2),
        line(0, "f", "1. A note at the foot of the page", 60, 60, 300, h=10),
        line(0, "z", "and its second paragraph", 60, 30, 300, h=10),
    ]
    units, _ = by_block(spark, rows)
    assert (units["t"].content_class, units["t"].rule) == ("heading", "heading")
    assert units["b0"].blocks == ["b0", "b1", "b2"] and units["b0"].content_class == "prose"
    assert units["c"].spoken_text == "Preface" and units["c"].text == "Preface .... 12"
    assert units["u"].content_class == "unsupported" and units["u"].disposition == "on_demand"
    assert units["f"].rule == "footnote" and units["z"].content_class == "note"
    assert units["f"].trace[0].rule == "footnote" and units["f"].trace[0].affected_segments == units["f"].blocks


def test_numbered_line_without_body_above_is_no_note(spark):
    units, _ = by_block(spark, [line(0, "a", "1. First of a list", 60, 100, 200), line(0, "b", "2. Second of it", 60, 86, 200)])
    assert {u.content_class for u in units.values()} == {"prose"}


def test_nulls_blanks_and_empty_table(spark):
    rows = [("d", 0, "a", None, 1.0, 1.0, 1.0, 1.0, 1.0), ("d", 0, "b", "  ", 1.0, 1.0, 1.0, 1.0, 1.0), ("d", 0, "c", "x", None, 1.0, 1.0, 1.0, 1.0), ("d", 0, "e", "Kept.", 1.0, 1.0, 9.0, 9.0, None)]
    units, got = by_block(spark, rows)
    assert set(units) == {"e"} and got[0].content_class == "unsupported"
    assert normalise.units(spark.createDataFrame([], LINES)).count() == 0
