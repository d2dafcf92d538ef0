"""The state of a run is read and written as one row."""

import json

from pyspark.sql import Row

from opinia.streaming import state


class Store:
    """One state variable of a run; counts the calls, each of which is a round trip."""

    calls = 0

    def __init__(self):
        self.value, self.map = None, {}

    def get(self):
        Store.calls += 1
        return self.value

    def update(self, value):
        Store.calls += 1
        self.value = value

    def containsKey(self, key):
        Store.calls += 1
        return key in self.map

    def getValue(self, key):
        Store.calls += 1
        return self.map.get(key)

    def removeKey(self, key):
        Store.calls += 1
        del self.map[key]

    def updateValue(self, key, value):
        Store.calls += 1
        self.map[key] = value


def step(rule, *pages):
    """The pages decided, with the ids kept on each, and the calls that took."""
    Store.calls = 0
    rows = [Row(page=p, captured=at, facts=json.dumps({"header": p if p > 1 else None}), reviews=json.dumps(
        [{"pair": f"p{i}", "review_id": i} for i in ids])) for p, at, *ids in pages]
    out = list(rule.handleInputRows(("run",), iter(rows), None))
    return [(r.page, [x["review_id"] for x in json.loads(r.reviews)], r.kept_so_far, r.header_total) for r in out], Store.calls


def test_a_run_costs_one_read_and_one_write():
    rule = state.GreedyRule()
    rule.init(type("Handle", (), {"getValueState": lambda *_: Store(), "getMapState": lambda *_: Store()})())
    assert step(rule, (1, 5, "a", "b"), (2, 5, "b", "c")) == ([(1, ["a", "b"], 2, None), (2, ["c"], 3, 2)], 2)
    assert step(rule, (3, 5, "a", "d")) == ([(3, ["d"], 4, 2)], 2)
    assert step(rule, (2, 9, "z")) == ([], 1)
    # Pages wait for an earlier one; of two captures that wait the later counts, as does one that arrives with it.
    assert step(rule, (6, 5, "f"), (7, 5, "g"))[0] == []
    assert step(rule, (6, 6, "h"))[0] == []
    assert step(rule, (4, 5, "a"), (5, 5), (7, 6, "h", "i"))[0] == [
        (4, [], 4, 2), (5, [], 4, 2), (6, ["h"], 5, 2), (7, ["i"], 6, 2)]
    assert rule.waiting.map == {} and rule.run.value[3] == 0
    assert step(rule, (8, 5, "g")) == ([(8, ["g"], 7, 2)], 2)
