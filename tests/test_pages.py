"""State in pages: few round trips, and nothing lost when pages divide."""

import random

import pandas as pd

from tallygrid.streaming import pages, upsert


class Stored:
    """A state variable that counts its round trips."""

    def __init__(self, trips):
        self.held, self.trips = {}, trips

    def getValue(self, key):
        self.trips.append(key)
        return self.held.get(key)

    def updateValue(self, key, value):
        self.trips.append(key)
        self.held[key] = value

    def exists(self):
        return () in self.held

    def get(self):
        return self.getValue(())

    def update(self, value):
        self.updateValue((), value)


class Handle:
    def __init__(self):
        self.trips = []

    def getMapState(self, name, keys, values):
        return Stored(self.trips)

    def getValueState(self, name, values):
        return Stored(self.trips)


def test_pages_hold_what_a_dict_holds():
    draw, handle, wanted = random.Random(5), Handle(), {}
    state = pages.Pages(handle, "newest")
    for _ in range(12):
        state.open()
        assert dict(state.items()) == {k: list(v) for k, v in wanted.items()}
        for _ in range(400):
            key = f"ключ {draw.randrange(3000)}\n"
            if draw.random() < 0.2:
                state.remove(key)
                wanted.pop(key, None)
            else:
                wanted[key] = (draw.randrange(1 << 62), draw.random(), "text ")
                state.put(key, wanted[key])
        state.save()
    state.open()
    assert dict(state.items()) == {k: list(v) for k, v in wanted.items()}
    assert state.get("no such key") is None


def test_a_call_reads_pages_and_not_keys():
    handle, order = Handle(), ["epoch", "q0"]
    processor = upsert._KeepNewest(order, False)
    processor.init(handle)
    reduce = upsert._newest_per_batch(order, False)
    count = 20_000
    for number in (0, 1):
        rows = pd.DataFrame({"key": [f"={i}" for i in range(count)], "epoch": 0, "q0": number, "body": "{}", "bucket": 3})
        packed = pd.concat(reduce(iter([rows])))
        handle.trips.clear()
        signed = pd.concat(processor.handleInputRows((3,), iter([packed]), None))
        assert signed["sign"].sum() == (count if number == 0 else 0) and len(signed) == count * (1 + number)
        assert len(handle.trips) < count / 20


def test_flat_points_of_a_version_are_put_together_across_batches():
    order = ["epoch", "q0"]
    rows = pd.DataFrame({"key": ["=a", "=b", "=a", "=a"], "epoch": 0, "q0": [1, 1, 1, 2], "body": ["{1}", "{2}", "{3}", "{4}"], "bucket": 7})
    packed = pd.concat(upsert._newest_per_batch(order, False)(iter([rows.iloc[:2], rows.iloc[2:]])))
    kept = [v for versions in upsert._unpacked(iter([packed[packed["bucket"] >= 0]])) for v in versions]
    left = [v for versions in upsert._unpacked(iter([packed[packed["bucket"] < 0]])) for v in versions]
    assert sorted(kept) == [("=a", 0, 2, "{4}"), ("=b", 0, 1, "{2}")] and left == [("=a", 0, 1, "{1}\n{3}")]
