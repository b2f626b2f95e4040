"""Ordered action logs folded into state: page sessions and narration queues.

One key's log is folded in one task; a session has one row per user action, which a reader bounds, and keys are
spread by hash. The streaming twins in ``quireflow.streaming`` keep the same state between micro-batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import ship

SESSION = "session string, page_index int, state string, error_code string, invalid long"
QUEUE = "session string, position int, length int, state string"


def new_pages(count: int) -> dict[int, list]:
    return {i: ["pending", None] for i in range(count)}


def advance(pages: dict[int, list], visible: int, cancelled: bool) -> None:
    """Start the pending page nearest the visible one (the lower index on a tie), unless one runs or all stopped."""
    if cancelled or any(p[0] == "processing" for p in pages.values()):
        return
    waiting = [i for i, p in pages.items() if p[0] == "pending"]
    if waiting:
        pages[min(waiting, key=lambda i: (abs(i - visible), i))][0] = "processing"


def apply_action(pages: dict[int, list], visible: int, cancelled: bool, action: str, page: int) -> tuple[bool, int, bool]:
    """(valid, visible, cancelled) after one action; an invalid one leaves the state as it was."""
    p = pages.get(page)
    state = p[0] if p else None
    if action == "show" and p:
        visible = page
    elif action == "complete" and state == "processing":
        p[:] = ["completed", None]
    elif action == "fail" and state == "processing":
        p[:] = ["failed", "PAGE_FAILED"]
    elif action == "retry" and state == "failed":
        p[:] = ["pending", None]
    elif action == "skip" and state in ("pending", "failed"):
        p[:] = ["skipped", None]
    elif action == "reread" and state in ("completed", "failed", "skipped"):
        p[:] = ["pending", None]
    elif action == "cancel":
        cancelled = True
        for q in pages.values():
            if q[0] == "processing":
                q[0] = "pending"
    elif action == "resume":
        cancelled = False
    else:
        return False, visible, cancelled
    advance(pages, visible, cancelled)
    return True, visible, cancelled


def fold_session(log: pd.DataFrame, count: int) -> tuple[dict[int, list], int]:
    pages, visible, cancelled, invalid = new_pages(count), 0, False, 0
    advance(pages, visible, cancelled)
    for action, page in zip(log["action"], log["page_index"]):
        ok, visible, cancelled = apply_action(pages, visible, cancelled, action, int(page))
        invalid += not ok
    return pages, invalid


def fold_sessions(log: DataFrame, count: int = 8) -> DataFrame:
    """session, page_index, state, error_code, invalid from (session, seq, action, page_index)."""
    ship(log.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pages, invalid = fold_session(pdf.sort_values("seq", kind="stable"), count)
        return pd.DataFrame([(pdf["session"].iloc[0], i, s, e, invalid) for i, (s, e) in pages.items()], columns=["session", "page_index", "state", "error_code", "invalid"])

    return log.groupBy("session").applyInPandas(run, SESSION)


def fold_queue(ops: list[tuple[str, int]]) -> tuple[int, int, str]:
    """(position, length, state) of a narration queue after append and advance operations."""
    position = length = 0
    state = "awaiting_content"
    for op, n in ops:
        if op == "append":
            length += n
            if state == "awaiting_content" and position < length:
                state = "ready"
        elif op == "advance" and state == "ready":
            position += 1
            if position >= length:
                state = "awaiting_content"
        elif op == "finish" and state == "awaiting_content":
            state = "completed"
    return position, length, state


def fold_queues(log: DataFrame) -> DataFrame:
    ship(log.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        p, n, s = fold_queue(list(zip(pdf["action"], pdf["page_index"])))
        return pd.DataFrame([(pdf["session"].iloc[0], p, n, s)], columns=["session", "position", "length", "state"])

    return log.groupBy("session").applyInPandas(run, QUEUE)
