"""The audit of a shift over the sorted table, against the shift itself."""

import random
import statistics

import pytest

from txnlens.operators import audit


def shifted(rows, size):
    """{first payment's id: (whose values, mean, deviation)} by a walk over the sorted rows."""
    out, before, seen = {}, None, []
    group = None
    for customer, id_, time, amount, recipient in sorted(rows, key=lambda r: (r[0], r[4], r[2], r[1])):
        if (customer, recipient) != group:
            if before:
                out[id_] = before
            group, seen = (customer, recipient), []
        seen = [*seen, amount][-size:]
        std = statistics.stdev(seen) if len(seen) > 1 else None
        before = (*group, statistics.fmean(seen), std)
    return out


@pytest.mark.parametrize("size", [1, 3, 30])
@pytest.mark.parametrize("parts", [1, 7, 400])
def test_shift_audit(payments, size, parts):
    rng = random.Random(5)
    rows = [
        (rng.choice("AAABCD"), f"t{k:04d}", f"2024-01-0{rng.randint(1, 3)} 00:00:0{rng.randint(0, 9)}", rng.randint(1, 900) / 4, rng.choice("uvwxyz"))
        for k in range(600)
    ]
    got = {
        r.transaction_id: (r.from_customer, r.from_recipient, r.shifted_mean, r.shifted_std)
        for r in audit.shift_audit(payments(rows), size, parts).collect()
    }
    want = shifted(rows, size)
    assert got.keys() == want.keys() and len(want) == 23
    for key, (customer, recipient, mean, std) in want.items():
        assert got[key][:2] == (customer, recipient)
        assert got[key][2:] == (pytest.approx(mean), std if std is None else pytest.approx(std))


def test_large_groups_are_thinned_before_the_shuffle(payments):
    plan = audit.last_rolling(payments([("A", "t", "2024-01-01", 1.0, "r")]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Partial") >= 1


def test_no_payments(payments):
    one = payments([("A", "t", "2024-01-01", 1.0, "r")])
    assert audit.shift_audit(one).collect() == []
    assert audit.shift_audit(one.where("false")).collect() == []
