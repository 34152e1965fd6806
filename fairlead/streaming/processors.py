"""Processors with state per key. Rows of a key come in frames, or one by one where keys are many: a frame costs more than
a key's few rows. Only what a key has to remember is kept, as one value that
takes one message to read and one to write."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of a key that are held at once where they can be taken bit by bit.
RUN = 10_000


def held(state) -> tuple | None:
    """What a value state holds, in one message to the store."""
    return state.get()


def kept(state, rows: list[tuple]) -> None:
    """A state of one array holds these rows from now on. A list of the store would take several messages a key."""
    state.update((rows,)) if rows else state.clear()


class StatusHistory(StatefulProcessor):
    """Transitions of a user's listings: every change of status and every dismissal with a reason, the last `keep` of each
    listing. What a message to the store costs is paid per user and batch, not per listing; only listings that the batch
    touches are told. Times are microseconds."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", "listings array<struct<listing_id:long,status:string,log:array<struct<event_id:long,at:long,from_status:string,to_status:string,dismiss_reason:string>>>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = {x[0]: (x[1], x[2]) for x in (held(self.state) or ([],))[0]}
        new = sorted(((r["at"] is None, r["at"], r["event_id"], r["listing_id"], r["status"], r["dismiss_reason"]) for r in rows), key=lambda x: x[:3])
        touched = {}
        for _, at, event, listing, status, reason in new:
            if listing not in touched:
                last, log = known.get(listing, (None, []))
                touched[listing] = [last, [tuple(x) for x in log]]
            entry = touched[listing]
            if status != entry[0] or reason is not None:
                entry[1].append((event, at, entry[0], status, reason))
                del entry[1][:-self.keep]
            entry[0] = status
        known.update(touched)
        self.state.update(([(listing, last, log) for listing, (last, log) in known.items()],))
        for listing, (_, log) in touched.items():
            for event, at, before, after, reason in log:
                yield Row(user_id=key[0], listing_id=listing, event_id=event, at=at, from_status=before, to_status=after, dismiss_reason=reason)

    def close(self) -> None:
        pass


class SourceHealth(StatefulProcessor):
    """Failed runs of a source since its last completed one."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "failures long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failed, clean = [], None
        for frame in rows:
            at = list(zip(frame["finished_at"], frame["run_id"]))
            done = [a for a, s in zip(at, frame["status"]) if s == "completed"]
            clean = max([clean, *done] if clean else done, default=clean)
            failed = [a for a in failed + [a for a, s in zip(at, frame["status"]) if s == "failed"] if clean is None or a > clean]
        before = (held(self.streak) or (0,))[0] if clean is None else 0
        n = before + len(failed)
        self.streak.update((n,))
        yield pd.DataFrame({"source_id": [key[0]], "consecutive_failures": [n], "deactivate": [n >= self.most]})

    def close(self) -> None:
        pass


class PendingQueue(StatefulProcessor):
    """The deferred items of a source, at most `cap`; from a batch no more than that many candidates are held."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getValueState("queue", "entries array<struct<url:string,title:string,pos:long>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = [tuple(x) for x in (held(self.queue) or ([],))[0]]
        seen, new, done = {url for url, _, _ in old}, {}, set()
        for frame in rows:
            for url, title, pos, gone in zip(frame["url"], frame["title"], frame["pos"].tolist(), frame["done"]):
                if gone:
                    done.add(url)
                elif url and url not in seen:
                    new[url] = min(new.get(url, (pos, title)), (pos, title))
            new = dict(sorted(new.items(), key=lambda x: (x[1][0], x[0]))[: self.cap])
        queue = (old + [(url, title, pos) for url, (pos, title) in new.items()])[: self.cap]
        queue = [entry for entry in queue if entry[0] not in done]
        kept(self.queue, queue)
        told = [(key[0], k, *entry) for k, entry in enumerate(queue)] or [(key[0], -1, None, None, None)]
        yield pd.DataFrame(told, columns=["source_id", "place", "url", "title", "pos"]).astype({"pos": "Int64"})

    def close(self) -> None:
        pass


class Bursts(StatefulProcessor):
    """Bursts of a user's events: one ends when `gap` microseconds pass without an event. A burst is over once the
    watermark has passed its end, as no event that comes in time can join it any more; one timer a user sees to that."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "bursts array<struct<started:long,ended:long,changes:long>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        bursts = [tuple(x) for x in (held(self.open) or ([],))[0]]
        for at in iter(lambda: [r["at"] for r in islice(rows, RUN)], []):
            bursts = self.merged(bursts + [(t, t + self.gap, 1) for t in at])
        yield from self.told(key, bursts, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        bursts, watermark = [tuple(x) for x in (held(self.open) or ([],))[0]], timerValues.getCurrentWatermarkInMs()
        if any(b[1] <= watermark * 1000 for b in bursts):  # else an earlier call has told all
            yield from self.told(key, bursts, watermark)

    def merged(self, bursts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        for started, ended, changes in sorted(bursts):
            if out and started < out[-1][1]:
                out[-1] = out[-1][0], max(ended, out[-1][1]), out[-1][2] + changes
            else:
                out.append((started, ended, changes))
        return out

    def told(self, key, bursts: list[tuple[int, int, int]], watermark_ms: int) -> list[Row]:
        still = [b for b in bursts if b[1] > watermark_ms * 1000]
        kept(self.open, still)
        if still:  # the first end to come; whoever is called then asks for the next
            self.handle.registerTimer(-(-min(b[1] for b in still) // 1000))
        rows = [(*b, True) for b in bursts if b[1] <= watermark_ms * 1000] + [(*b, False) for b in still]
        rows = rows if still else [*rows, (None, None, None, False)]
        return [Row(user_id=key[0], started=started, ended=ended, changes=changes, closed=closed) for started, ended, changes, closed in rows]

    def close(self) -> None:
        pass
