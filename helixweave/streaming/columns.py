"""A matrix that grows by columns: chunks of sequence b arrive, keyed state holds the last column.

For each key the state is the right border of the columns seen so far and the best cell; memory is that of one
column, whatever the length of b. Chunks may arrive out of order: those that cannot be used yet wait in the state.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from helixweave.functions import kernels as K
from helixweave.functions.scoring import INF, Edges, Scores, border

_OUT = "aid long, bid long, columns long, score long, end_i long, end_j long"
_STATE = "no long, columns long, h binary, e binary, score long, end_i long, end_j long, waiting binary"


def extend(a: np.ndarray, b: np.ndarray, columns: int, h: np.ndarray, e: np.ndarray, best: tuple[int, int, int], edges: Edges, sc: Scores) -> tuple:
    """(h, e, best) of the matrix of a with so many columns, extended by the symbols b."""
    top = border("zeroes" if edges.free_row else "gaps", columns + len(b), sc, columns)
    _, _, rh, re, (s, i, j) = K.block(a, b, top, np.full(len(b) + 1, -INF, np.int32), h, e, edges.local, sc)
    # equal scores: the smaller i, then the smaller j; earlier columns win at one i
    if s > best[0] or s == best[0] > 0 and i < best[1]:
        best = (s, i, columns + j)
    return rh, re, best


def grow(chunks: DataFrame, edges: Edges = Edges(), scores: Scores = Scores()) -> DataFrame:
    """(aid, bid, columns, score, end_i, end_j) after each trigger, for a stream (aid, bid, a, no, bases); ends anywhere.

    no counts a pair's chunks from 0. Use update mode.
    """
    if edges.end != "*":
        raise ValueError("the end of a growing matrix is not known: only best cells anywhere are kept")

    def step(key, frames, state: GroupState):
        if state.exists:
            no, columns, h, e, *best, waiting = state.get
            waiting = pickle.loads(waiting)
        else:
            no, columns, h, e, best, waiting = 0, 0, None, None, [0, -1, -1], {}
        a = None
        for f in frames:
            a = f["a"].iloc[0]
            waiting |= dict(zip(f["no"].tolist(), f["bases"].tolist(), strict=True))
        x = K.codes(a or "")
        if h is None:
            side = border("zeroes" if edges.free_column else "gaps", len(x), scores), np.full(len(x) + 1, -INF, np.int32)
        else:
            side = np.frombuffer(h, np.int32), np.frombuffer(e, np.int32)
        best = tuple(best)
        while no in waiting:
            y = K.codes(waiting.pop(no) or "")
            if len(y) and len(x):
                *side, best = extend(x, y, columns, *side, best, edges, scores)
            no, columns = no + 1, columns + len(y)
        # chunks that were used already may come again
        waiting = {k: v for k, v in waiting.items() if k > no}
        state.update((no, columns, side[0].tobytes(), side[1].tobytes(), *map(int, best), pickle.dumps(waiting)))
        yield pd.DataFrame([(*key, columns, *best)], columns=[c.split()[0] for c in _OUT.split(", ")])

    return chunks.groupBy("aid", "bid").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def follow(chunks: DataFrame, checkpoint: str, out: str, edges: Edges = Edges(), scores: Scores = Scores()) -> None:
    """Runs grow over everything that is there now, trigger by trigger; the rows of each go to a folder of out."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    grow(chunks, edges, scores).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
