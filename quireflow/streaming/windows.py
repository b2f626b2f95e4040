"""Structured Streaming over events and pages: windows with watermarks, deduplication, keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.evidence import Evidence, page_edges
from ..operators.sessions import advance, apply_action, new_pages
from ..runtime import ship


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_counts(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def once(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Each event id once, though delivered again within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def page_sessions(actions: DataFrame, count: int = 8) -> DataFrame:
    """The session state machine as keyed state; the batch form is ``operators.sessions.fold_sessions``."""
    ship(actions.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            states, errors, visible, cancelled = state.get
            pages = {i: [s, e or None] for i, (s, e) in enumerate(zip(states, errors))}
        else:
            pages, visible, cancelled = new_pages(count), 0, False
            advance(pages, visible, cancelled)
        log = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for action, page in zip(log["action"], log["page_index"]):
            _, visible, cancelled = apply_action(pages, visible, cancelled, action, int(page))
        state.update(([p[0] for p in pages.values()], [p[1] or "" for p in pages.values()], visible, cancelled))
        yield pd.DataFrame([(key[0], i, p[0]) for i, p in pages.items()], columns=["session", "page_index", "state"])

    return actions.groupBy("session").applyInPandasWithState(run, "session string, page_index int, state string", "states array<string>, errors array<string>, visible int, cancelled boolean", "update", GroupStateTimeout.NoTimeout)


def furniture_incremental(pages: DataFrame) -> DataFrame:
    """document_id, page_index, block_id, rule: what is stripped from each page with the evidence up to it.

    ``pages`` is a stream of document_id, page_index, lines (array of block_id, text, x, y, w, h), one row a page. The
    state of a document are its tallies; a page delivered again adds no evidence. Within a batch pages are taken in
    the order of their numbers.
    """
    ship(pages.sparkSession)
    fields = ["block_id", "text", "x", "y", "w", "h"]
    # Plain arrays, one for each field, reach Python in a fraction of the time that structs take.
    usable = pages.select("document_id", "page_index", F.filter("lines", lambda x: x["text"].isNotNull() & x["h"].isNotNull()).alias("lines"))
    pages = usable.select("document_id", "page_index", *[F.col(f"lines.{c}").alias(c) for c in fields])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        e = Evidence(state.get[0] if state.exists else None)
        out: dict[tuple, tuple] = {}
        rows = [r for b in batches for r in zip(b["page_index"].tolist(), *(b[c] for c in fields))]
        for page, *columns in sorted(rows, key=lambda r: r[0]):
            edges = page_edges([dict(zip(fields, x)) for x in zip(*(c.tolist() for c in columns))])
            e.observe(int(page), edges)
            for block, rule in e.strip(edges):
                out.setdefault((page, block), (key[0], page, block, rule))
        state.update((e.save(),))
        if out:
            yield pd.DataFrame(list(out.values()), columns=["document_id", "page_index", "block_id", "rule"])

    return pages.groupBy("document_id").applyInPandasWithState(run, "document_id string, page_index int, block_id string, rule string", "tallies string", "append", GroupStateTimeout.NoTimeout)


def bounded_buffer(operations: DataFrame, capacity: int) -> DataFrame:
    """session, pushed, popped, refused, starved, held: a queue of at most ``capacity`` items as keyed state.

    ``operations`` is a stream of session, seq, operation ('push' or 'pop'). A push to a full queue is refused, a pop
    from an empty one finds nothing; state and result are six numbers, however long the log."""
    ship(operations.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pushed, popped, refused, starved, held = state.get if state.exists else (0, 0, 0, 0, 0)
        for op in pd.concat(list(batches)).sort_values("seq", kind="stable")["operation"]:
            if op == "push" and held < capacity:
                pushed, held = pushed + 1, held + 1
            elif op == "push":
                refused += 1
            elif held:
                popped, held = popped + 1, held - 1
            else:
                starved += 1
        state.update((pushed, popped, refused, starved, held))
        yield pd.DataFrame([(key[0], pushed, popped, refused, starved, held)], columns=["session", "pushed", "popped", "refused", "starved", "held"])

    return operations.groupBy("session").applyInPandasWithState(run, "session string, pushed long, popped long, refused long, starved long, held long", "pushed long, popped long, refused long, starved long, held long", "update", GroupStateTimeout.NoTimeout)
