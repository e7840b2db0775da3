import numpy as np
import pandas as pd

from tickloom.streaming import twins


class Kept:
    """A value state without a store."""

    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v


def test_a_step_sees_bounded_slices_in_order():
    """A key's new rows come in any number of frames; the step runs over slices of them and its state goes from one to the next."""
    rng = np.random.default_rng(5)
    m, sizes = 150_000, []
    rows = pd.DataFrame({"symbol": "A", "ts": rng.permutation(m) // 3, "seq": rng.permutation(m), "price": rng.normal(size=m)})
    rolling = twins.rolling_step("price", 20)

    def step(part, st):
        sizes.append(len(part["price"]))
        return rolling(part, st)

    scan = twins.Scan(step, ["symbol"], ["ts", "seq"], ["symbol", "seq"], ["mean", "std"], [])
    scan.state = Kept()
    got = [pd.concat(scan.handleInputRows(("A",), iter(part), None)) for part in ([rows[:70_000][rows.ts[:70_000] < 0], rows[rows.ts < 30_000]], [rows[rows.ts >= 30_000][:20_000], rows[rows.ts >= 30_000][20_000:]])]
    want = rows.sort_values(["ts", "seq"], kind="stable").reset_index(drop=True)
    got = pd.concat(got, ignore_index=True)
    assert max(sizes) <= 1 << 16 and sum(sizes) == m
    assert (got.seq == want.seq).all() and (got.symbol == "A").all()
    assert np.allclose(got["std"][19:], want.price.rolling(20).std()[19:]) and got["std"][:19].isna().all()
