"""Many small states at once against one accumulator for each."""

import numpy as np
import pyarrow as pa
import pytest

from tallgram.operators import errors as E
from tallgram.operators import sketch as S
from tallgram.operators.kernels import Spec, accumulator, merger
from tallgram.operators.many import Pool, States, merged, together
from tallgram.streaming import sessions

SPECS = [
    Spec("batch_fd", 2, b=4), Spec("fd", 3), Spec("batch_pfd", 3, b=5, alpha=0.4), Spec("fd_median", 2),
    Spec("tweak_slow", 3, alpha=0.5), Spec("sparse_batch_pfd", 2, b=3, alpha=0.5), Spec("gram"),
    Spec("rand_batch_pfd", 2, b=3, alpha=0.5), Spec("qr"),
]


def some_states(rng, spec, counts, m=4):
    """States for runs of ``counts`` of them, as dicts and as columns."""
    rows = []
    for _ in range(sum(counts)):
        acc = merger(spec, m)
        if hasattr(acc, "add"):
            acc.add(rng.standard_normal((int(rng.integers(1, 12)), m)), None)
        rows.append(acc.state())
    columns = [np.array([r[c] for r in rows]) for c in ("m", "n_rows", "delta", "delta_first", "mass_lost")]
    data = [np.array(r["data"]) for r in rows]
    return [r | {"data": d} for r, d in zip(rows, data)], States(*columns, np.array([len(d) for d in data]), np.concatenate(data))


@pytest.mark.parametrize("final", [False, True])
@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.kind)
def test_merged_equals_merger(rng, spec, final):
    counts = [1, 3, 1, 9, 2, 30]
    rows, states = some_states(rng, spec, counts)
    heads = np.cumsum([0, *counts[:-1]])
    out = merged(states, heads, spec, final)
    ends = np.cumsum(out.cells)
    for n, (head, count) in enumerate(zip(heads, counts)):
        acc = merger(spec, 4)
        for row in rows[head : head + count]:
            acc.merge(row)
        state = acc.state(final)
        for name in ("m", "n_rows", "delta", "delta_first", "mass_lost"):
            np.testing.assert_allclose(getattr(out, name)[n], state[name], atol=1e-9)
        b, c = (x.reshape(-1, 4) for x in (out.data[ends[n] - out.cells[n] : ends[n]], state["data"]))
        assert b.shape == c.shape
        np.testing.assert_allclose(b.T @ b, c.T @ c, atol=1e-9)


def test_widths_differ_between_runs_not_within():
    states = States.joined([States.of_rows(np.ones((2, 3))), States.of_rows(np.ones((7, 2)))])
    out = merged(states, np.array([0, 2]), Spec("batch_fd", 2, b=1))
    assert out.m.tolist() == [3, 2] and out.n_rows.tolist() == [2, 7]
    with pytest.raises(ValueError, match="vectors of width"):
        merged(states, np.array([0, 1]), Spec("batch_fd", 2, b=1))


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_pool_keeps_every_row(rng, most):
    keys = [None if k == 0 else str(k) for k in rng.integers(0, 30, 500)]
    by, block = rng.integers(0, 3, 500), rng.standard_normal((500, 2))
    pool, found = Pool(Spec("batch_fd", 2, b=3), most), []
    for at in range(0, 500, 50):
        s = slice(at, at + 50)
        found += pool.add(pa.array(keys[s], pa.string()), by[s], [np.arange(500)[s]], [np.arange(500)[s]], States.of_rows(block[s]))
    found += pool.rest()
    total: dict = {}
    for names, part, (low,), (high,), states in found:
        for name, p, a, b, n in zip(names.to_pylist(), part.tolist(), low.tolist(), high.tolist(), states.n_rows.tolist()):
            old = total.get((name, p), (a, b, 0))
            total[name, p] = min(old[0], a), max(old[1], b), old[2] + n
    expected: dict = {}
    for n, name in enumerate(zip(keys, by.tolist())):
        old = expected.get(name, (n, n, 0))
        expected[name] = old[0], n, old[2] + 1
    assert total == expected


def keyed_rows(rng, n, keys, size=200):
    key = [None if k == 0 else f"k{k}" for k in rng.integers(0, keys, n)]
    block = rng.standard_normal((n, 2))
    for at in range(0, n, size):
        part = block[at : at + size]
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * 2, pa.int32()), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), vec, pa.array(key[at : at + size], pa.string())], ["row_id", "vec", "key"])


def test_tasks_make_no_accumulator_for_each_of_many_keys(rng, monkeypatch):
    """Rows of very many keys are added up, merged and scored by steps over arrays, the same as one by one."""
    specs = (Spec("batch_fd", 2, b=3), Spec("gram", grid_id=1))
    batches = list(keyed_rows(rng, 4000, 700))
    plain = []
    with monkeypatch.context() as m:
        m.setattr(S, "_many_keys", lambda keys: False)
        plain = list(S._absorb(iter(batches), specs, {}, None, S.LIVE_BYTES, 1 << 30))
    made = []

    def counted(kernel):
        return lambda *rest, **named: (made.append(1), kernel(*rest, **named))[1]

    monkeypatch.setattr(S, "accumulator", counted(accumulator))
    monkeypatch.setattr(S, "merger", counted(merger))
    states = list(S._absorb(iter(batches), specs, {}, None, S.LIVE_BYTES, 1 << 30))
    order = [("key", "ascending"), ("grid_id", "ascending"), ("part", "ascending"), ("phase", "ascending")]

    def combined(parts, function):
        table = pa.Table.from_batches(parts).combine_chunks().sort_by(order)
        out = pa.Table.from_batches(list(function(iter(table.to_batches(max_chunksize=97)), specs, True, False)))
        return out.append_column("turn", pa.array([k != "gram" for k in out["kind"].to_pylist()])).sort_by([("key", "ascending"), ("turn", "ascending")])

    many = combined(states, S._combine)
    assert not made
    one = combined(plain, lambda *rest: S.state_batches(S._combined(*rest)))
    assert many["key"].to_pylist() == one["key"].to_pylist() and many["n_rows"].to_pylist() == one["n_rows"].to_pylist()
    for name in ("mass_lost", "delta", "m", "filled", "l", "b"):
        np.testing.assert_allclose(many[name].to_numpy(), one[name].to_numpy(), atol=1e-8)
    scores = pa.Table.from_batches(list(E._measured_together(iter(one.to_batches(max_chunksize=31)), None))).to_pylist()
    spectra: dict = {}
    grams = {r["key"]: np.array(r["data"]).reshape(2, 2) for r in one.to_pylist() if r["kind"] == "gram"}
    rows = [r for r in one.to_pylist() if r["kind"] != "gram"]
    assert len(scores) == len(rows) > 650
    for got, row in zip(sorted(scores, key=lambda r: r["key"] or ""), sorted(rows, key=lambda r: r["key"] or "")):
        want = E._measured(row, np.array(row["data"]).reshape(-1, 2), grams[row["key"]], None, spectra)
        for name in ("key", "kind", "n_rows", "certified", "k"):
            assert got[name] == want[name]
        for name in ("sq_norm", "sketch_mass", "abs_err", "tail", "delta", "mass_lost"):
            assert got[name] == pytest.approx(want[name], abs=1e-8)
        assert (got["proj_err"] is None) == (want["proj_err"] is None)
        if want["proj_err"] is not None and want["tail"] > 1e-6:
            assert got["proj_err"] == pytest.approx(want["proj_err"], rel=1e-5)


@pytest.mark.parametrize("spec", [Spec("batch_fd", 2, b=3), Spec("rand_batch_pfd", 2, b=3, alpha=0.5)], ids=lambda s: s.kind)
def test_panes_of_many_keys_travel_together(rng, spec):
    """One row for each group and pane, not for each key: and every row of the input is in one of their states."""
    assert together(spec) == (spec.kind == "batch_fd")
    n, gap = 3000, 1000
    us = rng.integers(-5000, 5000, n)
    users = rng.integers(0, 900, n)
    rows = pa.Table.from_batches(list(keyed_rows(rng, n, 900))).drop_columns(["key"])
    rows = rows.append_column("key", pa.array([f"u{k}" for k in users])).append_column("us", pa.array(us)).append_column("grp", pa.array(users % 4, pa.int32()))
    out = pa.Table.from_batches(list(sessions.condense_panes(iter(rows.to_batches(max_chunksize=250)), spec, gap, 1 << 30)))
    assert out.num_rows <= (4 * 10 if together(spec) else 200)  # of 900 keys in 10 panes
    seen: dict = {}
    for row in out.to_pylist():
        for key, first, last, count in zip(row["keys"], row["first_us"], row["last_us"], row["n_rows"]):
            assert int(key[1:]) % 4 == row["grp"] and row["pane"] <= first <= last < row["pane"] + gap
            assert (key, row["pane"]) not in seen
            seen[key, row["pane"]] = first, last, count
    expected: dict = {}
    for user, t in zip(users.tolist(), us.tolist()):
        old = expected.get((f"u{user}", t // gap * gap), (t, t, 0))
        expected[f"u{user}", t // gap * gap] = min(old[0], t), max(old[1], t), old[2] + 1
    assert seen == expected
