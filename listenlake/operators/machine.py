"""State machines over ordered rows, as a parallel prefix of transition maps.

An event is a function from states to states, and the state after some events is the composition
of their functions, applied to the first state. Composition is associative: every part of a
group composes its own events, not knowing the state it begins in, and hands on one function;
the functions of the parts before it then say that state. A window's "last value seen" cannot
express this where an event's effect depends on the state it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from listenlake.operators.ordered import OrderedRows

BITS = 4  # of a state in a packed function
MASK = (1 << BITS) - 1


@dataclass(frozen=True)
class Machine:
    """States, the first of them at the start, and for each event the moves it makes.

    ``moves[event]`` maps states to the state that follows; in other states, and on unknown
    or missing events, the state stays.
    """

    states: tuple[str, ...]
    moves: dict[str, dict[str, str]]

    def __post_init__(self):
        if not 0 < len(self.states) <= 64 // BITS - 1:
            raise ValueError("a machine has one to fifteen states")

    def maps(self) -> np.ndarray:
        """One row for each event, then one that stays; the next state of every state."""
        at = {s: i for i, s in enumerate(self.states)}
        rows = [[at[own.get(s, s)] for s in self.states] for own in self.moves.values()]
        return np.array([*rows, range(len(self.states))], np.int64)

    def event_number(self, event: Column) -> Column:
        """Which row of ``maps`` an event is."""
        number = F.lit(len(self.moves))
        for i, name in enumerate(self.moves):
            number = F.when(event == name, i).otherwise(number)
        return number

    def state_name(self, number: Column) -> Column:
        return F.element_at(F.array(*[F.lit(s) for s in self.states]), number + 1)


def prefixes(maps: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each row the composition of its run's functions up to it.

    ``first`` marks the first row of a run; the first run goes on from ``before`` unless marked.
    Each round doubles the reach, so there are as many as bits in the longest run's length.
    """
    found, n = maps.copy(), len(maps)
    if n and not first[0]:
        found[0] = found[0][before]
    heads = np.flatnonzero(first)
    starts = np.zeros(n, np.int64)
    starts[heads] = heads
    reach = np.arange(n) - np.maximum.accumulate(starts) if n else starts
    step = 1
    while len(far := np.flatnonzero(reach >= step)):
        found[far] = np.take_along_axis(found[far], found[far - step], axis=1)
        step *= 2
    return found


def _folded(maps: np.ndarray):
    states = maps.shape[1]
    weights = np.int64(1) << np.arange(0, BITS * states, BITS, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = np.arange(states)
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.asarray(batch.column("_first").to_numpy(zero_copy_only=False), bool)
            after = prefixes(maps[batch.column("_event").to_numpy()], first, carried)
            before = np.concatenate([carried[None], after[:-1]])
            before[first] = np.arange(states)
            carried = after[-1]
            kept = [c for c in batch.schema.names if c not in ("_first", "_event")]
            columns = [*(batch.column(c) for c in kept), pa.array(before @ weights), pa.array(after @ weights)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "_before", "_after"])

    return run


def _apply(packed: Column, state: Column) -> Column:
    """A packed function of a state number."""
    moved = F.call_function("shiftright", packed, (state * BITS).cast("int"))
    return moved.bitwiseAND(F.lit(MASK)).cast("int")


def fold(rows: OrderedRows, machine: Machine, event: str, before: str, after: str) -> OrderedRows:
    """Add the state before and after each row's event.

    Rows are scanned in order within each part of a group, as many at once as an Arrow batch
    holds, and nothing but one function is kept from batch to batch. The states that parts of
    cut groups begin in come from one row a part.
    """
    window = rows.window()
    marked = rows.rows.withColumns(
        {
            "_first": F.row_number().over(window) == 1,
            "_last": F.lead(F.lit(1)).over(window).isNull(),
            "_event": machine.event_number(F.col(event)),
        }
    )
    # The window has sorted its partitions so; the sort says that the scan relies on it.
    in_order = marked.sortWithinPartitions(*rows.sort_order())
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema if f.name not in ("_first", "_event"))
    scanned = in_order.mapInArrow(_folded(machine.maps()), f"{kept}, _before long, _after long")
    whole = F.max(F.when(F.col("_last"), F.col("_after"))).alias("_part")

    def carry(pieces: Window) -> dict[str, Column]:
        earlier = F.collect_list("_part").over(pieces.rowsBetween(Window.unboundedPreceding, -1))
        return {"_begins": F.aggregate(earlier, F.lit(0), lambda state, part: _apply(part, state))}

    joined = rows.carried(scanned, [whole], carry)
    begins = F.coalesce("_begins", F.lit(0))
    states = {c: machine.state_name(_apply(F.col(f), begins)) for c, f in ((before, "_before"), (after, "_after"))}
    return replace(rows, rows=joined.withColumns(states).select(*rows.rows.columns, *states))

