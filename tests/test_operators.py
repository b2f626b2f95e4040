"""Literal cases of the operators' behaviour."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.functions import prosody
from quireflow.functions.native import nearest_percentile, stable_id, template, upper_median
from quireflow.operators import furniture, matching, paragraphs, quality, sessions

LINE = "document_id string, page_index int, block_id string, text string, x double, y double, w double, h double, confidence double"


def furniture_book():
    """Eight pages: a running head missing on page 3, two body lines, an imprint with the page number."""
    out = []
    for p in range(8):
        if p != 3:
            out.append(("d", p, f"{p}-head", "THE BOOK", 200.0, 780.0, 100.0, 10.0, 1.0))
        out.append(("d", p, f"{p}-a", f"Body line one of page {'abcdefgh'[p]}", 72.0, 700.0, 400.0, 12.0, 1.0))
        out.append(("d", p, f"{p}-b", f"Body line two of page {'ijklmnop'[p]}", 72.0, 685.0, 400.0, 12.0, 1.0))
        out.append(("d", p, f"{p}-foot", f"Imprint, page {p}", 200.0, 30.0, 90.0, 10.0, 1.0))
    return out


def test_furniture_removed_and_body_kept(spark):
    lines = spark.createDataFrame(furniture_book(), LINE)
    got = {(r.block_id, r.rule) for r in furniture.removed(lines).collect()}
    assert got == {(f"{p}-head", "remove_repeated_header") for p in range(8) if p != 3} | {(f"{p}-foot", "remove_repeated_footer") for p in range(8)}
    assert furniture.kept(lines).count() == 16


def test_furniture_of_short_documents_and_empty_table(spark):
    lines = spark.createDataFrame(furniture_book()[:4], LINE)
    assert furniture.removed(lines.where("false")).count() == 0
    assert furniture.removed(lines).count() >= 0


def test_order_of_pages_does_not_matter(spark):
    lines = spark.createDataFrame(furniture_book()[::-1], LINE)
    assert furniture.removed(lines).count() == 15


def test_paragraph_of_justified_lines_is_one_group(spark):
    rows = [("d", 0, f"l{i}", f"line {i}" + ("-" if i == 2 else ""), 75.0, 700.0 - 15 * i, 400.0, 15.0, 1.0) for i in range(6)]
    got = paragraphs.paragraph_groups(spark.createDataFrame(rows, LINE)).collect()
    assert len(got) == 1 and got[0].blocks == 6
    assert got[0].text == "line 0 line 1 line 2line 3 line 4 line 5"


def test_indent_and_distance_break_paragraphs(spark):
    rows = [("d", 0, "a", "one", 75.0, 700.0, 400.0, 15.0, 1.0), ("d", 0, "b", "two", 95.0, 685.0, 380.0, 15.0, 1.0), ("d", 0, "c", "three", 75.0, 600.0, 400.0, 15.0, 1.0), ("d", 0, "x", None, 1.0, 1.0, 1.0, 1.0, None)]
    assert paragraphs.paragraph_groups(spark.createDataFrame(rows, LINE)).count() == 3


def test_quality_signals(spark):
    prose = "La bibliotecaria leyó el capítulo más difícil en la estación vieja. " * 12
    shifted = "".join(chr(ord(c) + 1) if c.isascii() and c.isalpha() and c not in "zZ" else c for c in prose)
    spaced = " ".join("palabras separadas letra por letra en toda la hoja " * 12)
    rows = [("sound", prose, "es"), ("spaced", spaced, "en"), ("shift", "Xjs mbt xptsdw qrgt " * 40, "en"), ("plain", "the plain words of an english page without any accent " * 12, "es"), ("short", "corto", "es"), ("empty", "", "es"), ("none", None, "es")]
    got = {r.id: r.degradation for r in quality.degradation(quality.counters(spark.createDataFrame(rows, "id string, text string, language string"))).collect()}
    assert got == {"sound": None, "spaced": "letters_not_words", "shift": "impossible_words", "plain": "missing_diacritics", "short": None, "empty": None, "none": None}
    assert shifted != prose


def test_percentiles_and_median(spark):
    df = spark.createDataFrame([([float(i) for i in range(1, 11)],)], "v array<double>")
    r = df.select(nearest_percentile(F.col("v"), 0.1).alias("p"), upper_median(F.col("v")).alias("m")).first()
    assert (r.p, r.m) == (2.0, 6.0)


def test_stable_id_matches_hashlib(spark):
    parts = ["doc", "7", "bloqué", "paragraph", "0"]
    data = b"".join(len(p.encode()).to_bytes(8, "little") + p.encode() for p in parts)
    got = spark.range(1).select(stable_id("unit", *[F.lit(p) for p in parts]).alias("i")).first().i
    assert got == "unit_" + hashlib.sha256(data).hexdigest()


def test_template(spark):
    assert spark.range(1).select(template(F.lit("  p.  12 of 340 ")).alias("t")).first().t == "p. # of #"


def test_pauses_numbers_and_abbreviations():
    text = "La Sra. Otero leyó el núm. 7.3 a las 18:40; pesaba 3,5 kilos."
    assert [k for k, _ in prosody.parts(text)] == ["text", "punctuation", "text", "punctuation"]
    assert prosody.sentences("Uno. Dos! ¿Tres? y más") == ["Uno.", "Dos!", "¿Tres?", "y más"]
    assert prosody.normalize("CHAPTER I.", "en") == "Chapter one."


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ,.;1", max_size=300), st.integers(5, 40))
def test_chunks_keep_all_words_and_the_limit(text, limit):
    out = prosody.chunks(text, limit)
    assert all(0 < len(c) <= limit for c in out)
    assert "".join("".join(out).split()) == "".join(text.split())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c."]), max_size=120))
def test_balanced_chunks(words):
    out = prosody.balanced_chunks(" ".join(words))
    assert " ".join(out).split() == words
    assert all(len(c.split()) <= 30 for c in out)


def test_repair_takes_letters_from_the_other_reading():
    assert prosody.repair_runs("la bi#lioteca", "la biblioteca") == "la biblioteca"
    assert prosody.repair_runs("la!casa", "la casa") == "la casa"
    assert prosody.repair_runs("x", "") == "x"
    assert prosody.lcs_length(list("abcde"), list("ace")) == 3


def test_session_machine(spark):
    log = [("s", 1, "complete", 0), ("s", 2, "fail", 1), ("s", 3, "retry", 1), ("s", 4, "complete", 5), ("s", 5, "cancel", 0), ("s", 6, "skip", 3)]
    rows = sessions.fold_sessions(spark.createDataFrame(log, "session string, seq long, action string, page_index int"), 4).collect()
    state = {r.page_index: r.state for r in rows}
    assert state[0] == "completed" and state[3] == "skipped" and rows[0].invalid == 1
    assert "processing" not in state.values()


def test_queue():
    assert sessions.fold_queue([("append", 2), ("advance", 0), ("advance", 0), ("finish", 0)]) == (2, 2, "completed")
    assert sessions.fold_queue([("advance", 0), ("append", 1)]) == (0, 1, "ready")


def test_greedy_matching_takes_each_box_once(spark):
    boxes = spark.createDataFrame([(0, i, "r", 0, i, 10, 10) for i in range(3)], "page long, id long, role string, x long, y long, w long, h long")
    got = matching.greedy_pairs(boxes, boxes, 0.5).collect()
    assert len({r.b for r in got}) == len(got)
    clusters = matching.first_fit_clusters(boxes.select("page", "id", "x", "y", "w", "h")).collect()
    assert {r.cluster for r in clusters} == {0}


def test_stream_state_equals_batch(spark, sf, tmp_path):
    from quireflow.plans import pipeline
    from quireflow.streaming import windows

    actions = pipeline._actions(spark, sf).select("session", "seq", "action", "page_index")
    path = str(tmp_path / "log")
    actions.coalesce(1).write.parquet(path)
    out = []
    q = windows.page_sessions(spark.readStream.schema(actions.schema).parquet(path)).writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {(r.session, r.page_index): r.state for r in sessions.fold_sessions(actions).collect()}
    assert {(r.session, r.page_index): r.state for r in out} == batch


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc", max_size=20), st.text(alphabet="abc", max_size=20))
def test_common_subsequence_against_brute_force(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert prosody.lcs_length(list(a), list(b)) == table[-1][-1] == len(prosody.lcs_pairs(a, b))


def test_incremental_furniture_ends_where_the_batch_does(spark, sf):
    """The last page of a document is stripped with all evidence, so it loses what the batch removes from it."""
    from quireflow.operators.evidence import Evidence, page_edges

    lines = spark.createDataFrame([("d", p, f"{p}-{k}", t, 50.0, y, w, 10.0) for p in range(8) for k, (t, y, w) in enumerate([(f"Head {p}", 780.0, 90.0), (f"{'abcdefgh'[p] * 5} body", 400.0, 400.0), (f"{'hgfedcba'[p] * 4} more", 380.0, 400.0), ("Imprint", 20.0, 80.0)])], "document_id string, page_index int, block_id string, text string, x double, y double, w double, h double")
    batch = {(r.page_index, r.block_id, r.rule) for r in furniture.removed(lines).collect()}
    e, last = Evidence(), set()
    rows = lines.orderBy("page_index").collect()
    for p in range(8):
        edges = page_edges([r.asDict() for r in rows if r.page_index == p])
        e.observe(p, edges)
        e.observe(p, edges)
        e = Evidence(e.save())
        last = {(p, b, rule) for b, rule in e.strip(edges)}
        assert bool(last) == (p >= 1)
    assert last == {x for x in batch if x[0] == 7} and len(last) == 2


def test_streams_read_a_table_of_several_files_as_one_of_a_single_file(spark, sf, tmp_path):
    """A table may be a folder of part files; its stream found none of them and left no result."""
    from quireflow.plans import registry

    for name in ("page_candidates", "events"):
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("st_furniture_incremental", "st_dedupe_watermark"):
        one, several = (sorted(map(tuple, registry.QUERIES[name](spark, d).collect())) for d in (sf, str(tmp_path)))
        assert one and one == several


def test_bounded_buffer_stream(spark, tmp_path):
    from quireflow.streaming import windows as streams

    rows = [("a", n, op) for n, op in enumerate(["pop", "push", "push", "push", "pop", "pop", "pop"])]
    spark.createDataFrame(rows, "session string, seq long, operation string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, seq long, operation string").parquet(str(tmp_path / "in"))
    q = streams.bounded_buffer(stream, 2).writeStream.outputMode("update").format("memory").queryName("buffer").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.sql("SELECT * FROM buffer").collect()[-1]
    assert (r.pushed, r.popped, r.refused, r.starved, r.held) == (2, 2, 1, 2, 0)
