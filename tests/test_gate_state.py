"""How often the stateful streams call the state store, with a store in memory."""

import pandas as pd

from foldwright.streaming import gates


class Store:
    def __init__(self):
        self.maps, self.calls = {}, 0

    def getMapState(self, name, *_):
        self.maps[name] = {}
        return Handle(self, self.maps[name])

    def getValueState(self, *_):
        return Value()


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, held):
        self.held = held


class Handle:
    def __init__(self, store, rows):
        self.store, self.rows = store, rows

    def _call(self, found):
        self.store.calls += 1
        return found

    def containsKey(self, key):
        return self._call(key in self.rows)

    def getValue(self, key):
        return self._call(self.rows.get(key))

    def updateValue(self, key, value):
        self._call(self.rows.update({key: value}))

    def removeKey(self, key):
        self._call(self.rows.pop(key))


def run(processor, frames):
    store = Store()
    processor.init(store)
    made = [tuple(r) for f in frames for part in processor.handleInputRows(("r",), iter([f]), None) for r in part.itertuples(index=False)]
    return made, store


def test_gate_calls_the_store_by_blocks_of_places():
    places = [p for start in (3, 2, 1) for p in range(start, 3001, 3)]
    frame = lambda part: pd.DataFrame({"sequence": part, "score": 1.0, "threshold": 0.5, "reveal": False})
    made, store = run(gates._Gate("gated_binary", 10), [frame(places[i : i + 500]) for i in range(0, 3000, 500)])
    assert [m[1] for m in made] == list(range(1, 3001))
    assert [m[2] for m in made] == [None] * 10 + ["QUERY_BUDGET_EXCEEDED"] * 2990
    assert store.calls < 300 and not store.maps["waiting"]


def test_admission_calls_the_store_by_blocks_of_places():
    frame = lambda name: pd.DataFrame({"sequence": list(range(2000)), "event_id": name})
    made, store = run(gates._Admission(), [frame("a"), frame("a")])
    assert [m[1:] for m in made] == [(p, "a", None) for p in range(2000)]
    assert store.calls < 100
    again, _ = run(gates._Admission(), [frame("a"), frame("b").head(3), frame("b").head(3)])
    assert [m[3] for m in again[2000:]] == ["sequence_taken"] * 3
