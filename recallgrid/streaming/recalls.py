"""Order-dependent memory dynamics over recall events.

The state machine is sequential within one memory graph; graphs are independent, so events are keyed by graph and
each key's state is its energies, edges and window. ``replay`` folds a finite log; ``stream`` runs the same fold
as stateful streaming. Both share one step function.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

RESULT = "graph long, mem_id long, energy double, state string, access_count long"


def state_of(energy: float) -> str:
    return "active" if energy >= 0.3 else "dormant" if energy >= 0.1 else "deep" if energy >= 0.02 else "archived"


class Graph:
    """One memory graph. Unknown ids start at the given energy when they are first met."""

    def __init__(self, start: float = 1.0, strength: float = 0.2, rate: float = 0.1, damping: float = 0.5, window: int = 5):
        self.start, self.strength, self.rate, self.damping, self.size = start, strength, rate, damping, window
        self.energy: dict[int, float] = {}
        self.count: dict[int, int] = {}
        self.edges: dict[int, dict[int, float]] = {}
        self.window: list[int] = []

    def _lift(self, i: int, amount: float) -> None:
        self.energy[i] = min(1.0, self.energy.get(i, self.start) + amount)
        self.count[i] = self.count.get(i, 0) + 1

    def recall(self, i: int) -> None:
        self._lift(i, self.strength)
        if self.energy[i] < 0.1:
            return
        for other in self.window:
            if other != i and self.energy.get(other, self.start) >= 0.1:
                for a, b in ((i, other), (other, i)):
                    own = self.edges.setdefault(a, {})
                    own[b] = min(1.0, own[b] + self.rate) if b in own else min(self.rate, 0.5)
        self.window = [*self.window, i][-self.size :]
        for other, weight in list(self.edges.get(i, {}).items()):
            passed = self.strength * weight * self.damping
            if passed > 0.01:
                self._lift(other, passed)

    def rows(self) -> Iterable[tuple[int, float, str, int]]:
        for i in sorted(self.energy):
            yield i, self.energy[i], state_of(self.energy[i]), self.count[i]

    def dump(self) -> str:
        return json.dumps([sorted(self.energy.items()), sorted(self.count.items()), [(a, b, w) for a, x in self.edges.items() for b, w in x.items()], self.window])

    @classmethod
    def load(cls, text: str | None, **options) -> Graph:
        out = cls(**options)
        if text:
            energy, count, edges, out.window = json.loads(text)
            out.energy, out.count = dict(map(tuple, energy)), dict(map(tuple, count))
            for a, b, w in edges:
                out.edges.setdefault(a, {})[b] = w
        return out


def replay(log: DataFrame, **options) -> DataFrame:
    """(graph, ts, event_id, mem_id) to each graph's final energies."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Graph(**options)
        for i in pdf.sort_values(["ts", "event_id"])["mem_id"].tolist():
            g.recall(i)
        out = pd.DataFrame(list(g.rows()), columns=["mem_id", "energy", "state", "access_count"])
        out.insert(0, "graph", pdf["graph"].iloc[0])
        return out

    return log.select("graph", "ts", "event_id", "mem_id").groupBy("graph").applyInPandas(fold, RESULT)


def stream(log: DataFrame, **options) -> DataFrame:
    """The same on a stream; each batch gives the changed graphs' energies. Events of a batch are taken in order of time."""
    import pandas as pd

    def step(key, frames, state):
        g = Graph.load(state.get[0] if state.exists else None, **options)
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for i in pdf["mem_id"].tolist():
            g.recall(i)
        state.update((g.dump(),))
        out = pd.DataFrame(list(g.rows()), columns=["mem_id", "energy", "state", "access_count"])
        out.insert(0, "graph", key[0])
        yield out

    grouped = log.select("graph", "ts", "event_id", "mem_id").groupBy("graph")
    return grouped.applyInPandasWithState(step, RESULT, "graph string", "update", "NoTimeout")


class Neighbourhood(StatefulProcessor):
    """The fold of ``Graph`` over keyed state: an entry for each memory's energy and count, one for each memory's edges, and the window.
    An event reads and writes the entries of its memory, its neighbours and the window, never a whole graph."""

    def __init__(self, start: float = 1.0, strength: float = 0.2, rate: float = 0.1, damping: float = 0.5, window: int = 5) -> None:
        self.start, self.strength, self.rate, self.damping, self.size = start, strength, rate, damping, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        number, many = LongType(), ArrayType(LongType())
        one = StructType([StructField("mem_id", number)])
        self.levels = handle.getMapState("levels", one, StructType([StructField("energy", DoubleType()), StructField("count", number)]))
        self.edges = handle.getMapState("edges", one, StructType([StructField("to", many), StructField("weights", ArrayType(DoubleType()))]))
        self.recent = handle.getValueState("recent", StructType([StructField("ids", many)]))

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])["mem_id"].tolist()
        level: dict[int, tuple[float, int]] = {}
        edge: dict[int, dict[int, float]] = {}
        changed: set[int] = set()
        wired: set[int] = set()
        window = list(self.recent.get()[0]) if self.recent.exists() else []

        def of(i: int) -> tuple[float, int]:
            if i not in level:
                level[i] = tuple(self.levels.getValue((i,))) if self.levels.containsKey((i,)) else (self.start, 0)
            return level[i]

        def out(i: int) -> dict[int, float]:
            if i not in edge:
                edge[i] = dict(zip(*self.edges.getValue((i,)), strict=True)) if self.edges.containsKey((i,)) else {}
            return edge[i]

        def lift(i: int, amount: float) -> None:
            energy, count = of(i)
            level[i] = min(1.0, energy + amount), count + 1
            changed.add(i)

        for i in events:
            lift(i, self.strength)
            if of(i)[0] < 0.1:
                continue
            for other in window:
                if other != i and of(other)[0] >= 0.1:
                    for a, b in ((i, other), (other, i)):
                        own = out(a)
                        own[b] = min(1.0, own[b] + self.rate) if b in own else min(self.rate, 0.5)
                        wired.add(a)
            window = [*window, i][-self.size :]
            for other, weight in list(out(i).items()):
                passed = self.strength * weight * self.damping
                if passed > 0.01:
                    lift(other, passed)
        for i in changed:
            self.levels.updateValue((i,), level[i])
        for i in wired:
            self.edges.updateValue((i,), (list(edge[i]), list(edge[i].values())))
        self.recent.update((window,))
        told = [(key[0], i, level[i][0], state_of(level[i][0]), level[i][1]) for i in sorted(changed)]
        yield pd.DataFrame(told, columns=[c.split()[0] for c in RESULT.split(", ")])

    def close(self) -> None:
        pass


def stream_keyed(log: DataFrame, **options) -> DataFrame:
    """``stream`` over keyed state: each batch gives the energies that it changed. Needs the RocksDB state store."""
    grouped = log.select("graph", "ts", "event_id", "mem_id").groupBy("graph")
    return grouped.transformWithStateInPandas(Neighbourhood(**options), RESULT, "Update", "None")


def co_access(stream_of_recalls: DataFrame, watermark: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Recalls per memory and time window, late events beyond the watermark left out; state is bounded by the watermark."""
    from pyspark.sql import functions as F

    return stream_of_recalls.withWatermark("ts", watermark).groupBy(F.window("ts", width), "mem_id").agg(F.count("*").alias("recalls"))
