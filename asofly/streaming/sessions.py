"""Review sessions as a fold over their events, in batch and in a stream.

A session has four queues, one of them active, and hears of events: ``load`` (ids for a
queue), ``serve``, ``label``, ``skip`` (back to the end of a queue), ``expire`` (back to where it came from), ``switch`` and
``spend``. Its state follows from the events alone; what it answers to ``serve`` is a row:
the program, its queue, and whether it is a repeat. Every tenth serve of the main queue repeats a
labelled program, never the one repeated last where there are others. With a cap, nothing is served once
the costs heard of reach it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUEUES = ("main", "validation", "auto_review", "stratum_gap")
REPEAT_EVERY = 10
EVENT = "session string, seq long, kind string, queue string, ids array<string>, cost double"
SERVED = "session string, seq long, serve long, program_id string, queue string, is_repeat boolean"


@dataclass
class Session:
    """What a session knows; plain lists and maps, so that it is stored as JSON."""

    queues: dict[str, list[str]] = field(default_factory=lambda: {q: [] for q in QUEUES})
    active: str = "main"
    served: int = 0
    labelled: list[str] = field(default_factory=list)
    last_repeat: str | None = None
    origin: dict[str, str] = field(default_factory=dict)
    spent: float = 0.0

    def hear(self, session: str, seq: int, kind: str, queue: str | None, ids: list[str] | None, cost: float | None, cap: float | None) -> tuple | None:
        """Take an event in; for ``serve`` the row that answers it."""
        if queue is not None and queue not in QUEUES:
            raise ValueError(f"unknown queue {queue!r}")
        if kind == "load":
            self.queues[queue or self.active] += ids or []
        elif kind == "label":
            for x in ids or []:
                self.origin.pop(x, None)
                if x not in self.labelled:
                    self.labelled.append(x)
        elif kind == "skip":
            for x in ids or []:
                self.queues[queue or self.active].append(x)
                self.origin.pop(x, None)
        elif kind == "expire":
            for x in ids or []:  # a late return goes to the queue that it came from, whatever is active by now
                self.queues[self.origin.pop(x, self.active)].append(x)
        elif kind == "switch":
            self.active = queue or "main"
        elif kind == "spend":
            self.spent += cost or 0.0
        elif kind == "serve":
            return self._serve(session, seq, cap)
        else:
            raise ValueError(f"unknown event {kind!r}")
        return None

    def _serve(self, session: str, seq: int, cap: float | None) -> tuple:
        none = (session, seq, self.served, None, self.active, False)
        if cap is not None and self.spent >= cap:
            return none
        repeat = self.active == "main" and self.served > 0 and (self.served + 1) % REPEAT_EVERY == 0 and bool(self.labelled)
        if repeat:
            pool = [x for x in self.labelled if x != self.last_repeat] or self.labelled
            chosen = min(pool, key=lambda x: (zlib.crc32(f"{session}:{self.served}:{x}".encode()), x))
            self.last_repeat = chosen
        elif self.queues[self.active]:
            chosen = self.queues[self.active].pop(0)
        else:
            return none
        self.served += 1
        self.origin[chosen] = self.active
        return session, seq, self.served, chosen, self.active, repeat


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["session", "seq", "serve", "program_id", "queue", "is_repeat"])


def replay(events: DataFrame, cap: float | None = None) -> DataFrame:
    """Serves of all sessions from their logs (``EVENT`` columns): sessions lie in partitions, sorted by ``seq``, and one state is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, Session()
        for batch in batches:
            out = []
            for session, *event in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if session != current:
                    current, state = session, Session()
                if (row := state.hear(session, *event, cap)) is not None:
                    out.append(row)
            yield _batch(out)

    columns = [c.split()[0] for c in EVENT.split(", ")]
    return events.select(*columns).repartition("session").sortWithinPartitions("session", "seq").mapInArrow(run, SERVED)


def serve_stream(events: DataFrame, cap: float | None = None) -> DataFrame:
    """The same serves from a stream of events, each session's state kept as JSON; a micro-batch's events are taken in by ``seq``."""
    import pandas as pd

    def run(key, frames, state):
        session = Session(**json.loads(state.get[0])) if state.exists else Session()
        heard = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, kind, queue, ids, cost in zip(*(heard[c].tolist() for c in ("seq", "kind", "queue", "ids", "cost")), strict=True):
            row = session.hear(key[0], seq, kind, queue, list(ids) if ids is not None else None, None if pd.isna(cost) else cost, cap)
            if row is not None:
                out.append(row)
        state.update((json.dumps(asdict(session)),))
        yield pd.DataFrame(out, columns=["session", "seq", "serve", "program_id", "queue", "is_repeat"])

    return events.groupBy("session").applyInPandasWithState(run, SERVED, "state string", "append", "NoTimeout")


def open_cards(events: DataFrame, served: DataFrame) -> DataFrame:
    """(session, program_id, queue) served but neither labelled, skipped nor expired since: what a resumed run goes on with."""
    ended = events.where(F.col("kind").isin("label", "skip", "expire")).select("session", F.explode("ids").alias("program_id"), "seq").groupBy("session", "program_id").agg(F.max("seq").alias("_end"))
    last = served.where("program_id is not null").groupBy("session", "program_id").agg(F.max_by("queue", "seq").alias("queue"), F.max("seq").alias("_at"))
    return last.join(ended, ["session", "program_id"], "left").where("_end is null or _end < _at").select("session", "program_id", "queue")
