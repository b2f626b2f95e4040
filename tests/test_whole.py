"""Queries do the whole job: brute force on small tables where the oracle's SQL covers a part only."""

import hashlib
import math
from collections import defaultdict

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.functions import prosody
from quireflow.plans import pipeline, registry


def _by_page(spark, sf):
    pages = defaultdict(list)
    for r in pipeline.view(spark, sf, "rects").collect():
        pages[r.page].append(r)
    assert len(pages) >= 10
    return pages


def test_every_page_is_voted(spark, sf):
    want = {}
    for page, rs in _by_page(spark, sf).items():
        votes = {a.id: round(sum(1 / (1 + math.exp(-(a.y - b.y) / 100)) for b in rs if b.id != a.id), 6) for a in rs}
        want |= {(page, i): k + 1 for k, i in enumerate(sorted(votes, key=lambda i: (votes[i], i)))}
    assert {(r.page, r.id): r.rk for r in registry.QUERIES["agg_order_votes"](spark, sf).collect()} == want


def test_every_page_is_merged(spark, sf):
    want = {}
    for page, rs in _by_page(spark, sf).items():
        key = lambda r: (r.y, r.x, r.id)
        left, right = sorted((r for r in rs if r.x < 200), key=key), sorted((r for r in rs if r.x >= 200), key=key)
        if left and right:
            want |= {(page, r.id): k for k, r in enumerate(left + right)}
    assert {(r.page, r.id): r.ord for r in registry.QUERIES["prj_spread_regions"](spark, sf).collect()} == want


def test_windows_of_the_whole_text_in_any_script(spark, tmp_path):
    texts = {1: "1 " * 4000 + "late words " * 80, 2: "слово и дело " * 60, 3: "漢字仮名" * 90, 4: "abcdefghi\n" * 2000, 5: "short" * 30, 6: "few " * 20, 7: "𐐀𐐁 \r\n" * 300, 8: "", 10: "हिन्दी की " * 60}
    spark.createDataFrame([*texts.items(), (9, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for k, t in texts.items():
        ws = [(i // 200, t[i : i + 200]) for i in range(0, len(t), 200)]
        ws = [(i, w) for i, w in ws if len(regex.findall(r"\p{Alphabetic}", w)) >= 100]
        want |= {(k, i, w) for i, w in ([ws[j * len(ws) // 32] for j in range(32)] if len(ws) > 32 else ws)}
    got = [tuple(r) for r in registry.QUERIES["srt_voting_windows"](spark, str(tmp_path)).select("doc_id", "i", "window_text").collect()]
    assert len(got) == len(want) and set(got) == want and {k for k, _, _ in want} >= {1, 2, 3, 4, 5, 10}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcé漢", max_size=24), st.text(alphabet="abcé漢", max_size=24))
def test_edit_distance_against_brute_force(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        above, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
    assert prosody.edit_distance(a, b) == row[-1]


def test_character_error_of_accents_scripts_and_empty_texts():
    assert prosody.character_error("ano", "año") == (1, 3, 0.333333, False)
    assert prosody.character_error("año", "año") == (0, 3, 0.0, True)
    assert prosody.character_error("слово", "слева") == (2, 5, 0.4, False)
    assert prosody.character_error("x", "") == (1, 0, 1.0, False) and prosody.character_error("", "") == (0, 0, 0.0, False)
    assert prosody.character_error("é" * 19 + "e", "é" * 20) == (1, 20, 0.05, True)


def test_every_paragraph_has_its_error_rate(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "region.parquet"))  # the view's SQL has a column of that name
    texts = ["короткий", "ñ" * 399, "ñandú " * 200]
    blocks = [("d", 0, f"b{k}", k, t) for k, t in enumerate(texts)]
    spark.createDataFrame([(*b, None, None, None, None) for b in blocks], "document_id string, page_index int, block_id string, block_order int, text string, degradation string, revision int, confidence double, region array<double>").write.parquet(str(tmp_path / "blocks.parquet"))
    lines = [(f"d-p0-direct-{k}", t.replace("ñ", "n").replace("к", "x"), 0.0, 0.0, 1.0, 1.0, 1.0) for k, t in enumerate(texts)]
    spark.createDataFrame([("d", 0, lines, None)], "document_id string, page_index int, direct_blocks array<struct<block_id:string,text:string,x:double,y:double,w:double,h:double,confidence:double>>, ocr_blocks array<struct<block_id:string,text:string,x:double,y:double,w:double,h:double,confidence:double>>").write.parquet(str(tmp_path / "page_candidates.parquet"))
    got = {r.block_id: (r.edits, r.ref_length, r.passed) for r in registry.QUERIES["agg_cer"](spark, str(tmp_path)).collect()}
    assert got == {"b0": (2, 8, False), "b1": (399, 399, False), "b2": (200, 1200, False)}


def test_lines_of_every_scanned_block_are_matched_and_kept(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "region.parquet"))
    first, second = ["THE HEAD", "the first bl#ck of the page", "goes on with this line here"], ["another bl#ck begins down here", "its reading is poor", "no reading at all #"]
    blocks = [("d", 0, "z", 0, "\n".join(first)), ("d", 0, "a", 1, "\n".join(second)), ("d", 1, "lone", 0, "no page read #")]
    spark.createDataFrame([(*b, "scanned", None, None, None) for b in blocks], "document_id string, page_index int, block_id string, block_order int, text string, degradation string, revision int, confidence double, region array<double>").write.parquet(str(tmp_path / "blocks.parquet"))
    read = [(780.0, 9.0, 0.9, "THE HEAD"), (750.0, 12.0, 0.8, "the first block of the page"), (724.0, 12.0, 1.0, "goes on with this line here"), (698.0, 12.0, 0.9, "another block begins down here"), (672.0, 12.0, 0.5, "its reading is poor")]
    elements = [(f"d-p0-ocr-{k}", t, 72.0, y, 200.0, h, c) for k, (y, h, c, t) in enumerate(read)]
    element = "array<struct<block_id:string,text:string,x:double,y:double,w:double,h:double,confidence:double>>"
    spark.createDataFrame([("d", 0, None, elements)], f"document_id string, page_index int, direct_blocks {element}, ocr_blocks {element}").write.parquet(str(tmp_path / "page_candidates.parquet"))
    run = lambda q: registry.QUERIES[q](spark, str(tmp_path)).collect()
    best = {("z", 0): "d-p0-ocr-0", ("z", 1): "d-p0-ocr-1", ("z", 2): "d-p0-ocr-2", ("a", 0): "d-p0-ocr-3"}
    lines = {("z", 0), ("z", 1), ("z", 2), ("a", 0), ("a", 1), ("a", 2), ("lone", 0)}
    assert {(r.a_id, r.b_id) for r in run("join_ocr_line_fuzzy")} == {(f"{b}-line-{i}", o) for (b, i), o in best.items()}
    assert {(r.block_id, r.line_no): r.ocr_id for r in run("fn_lcs_pairs")} == {k: best.get(k) for k in lines}
    assert {r.block_id: r.common for r in run("fn_equiv_glyph")} == {"z": 8 + 26 + 27, "a": 29, "lone": 0}
    assert {r.block_id: r.text for r in run("fn_repair_page")} == {"z": "\n".join(first).replace("#", "o"), "a": "another block begins down here\nits reading is poor\nno reading at all #", "lone": "no page read #"}


def test_large_files_are_listed(spark, tmp_path):
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate((64 << 20) + 1)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a small.txt").write_text("abc")
    want = {"large.bin": ((64 << 20) + 1, hashlib.sha256(bytes((64 << 20) + 1)).hexdigest()), "a small.txt": (3, hashlib.sha256(b"abc").hexdigest())}
    assert {r.name: (r.length, r.sha256_hex) for r in registry.QUERIES["src_dir_walk"](spark, str(tmp_path)).collect()} == want
