"""Usual amounts and habitual places against their definitions, plain and with split histories."""

import math
import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from txnlens.operators import features
from txnlens.operators.skew import by_customer

SIZES = [{}, {"crowded_rows": 0, "chunk_rows": 9}]


def rows(large):
    rng = random.Random(3)
    out = []
    for k in range(160):
        time = f"2024-0{rng.randint(1, 3)}-{rng.randint(10, 12)} {rng.choice([7, 7, 19]):02d}:00:0{rng.randint(0, 3)}"
        amount = large + rng.choice([0.01, 0.02, 0.05, 1.5, 7.25])
        out.append((rng.choice("AAAB"), f"t{k:03d}", time, amount, "r", rng.choice(["X", "X", "Y", None])))
    return out


def earlier(all_rows, row):
    return [r for r in all_rows if r[0] == row[0] and (r[2], r[1]) < (row[2], row[1])]


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("large", [0.0, 1e9])
def test_usual_amounts(payments, large, sizes):
    given = rows(large)
    kinds = F.when(F.substring("transaction_id", 4, 1) < "5", "shop").otherwise("person")
    txn = payments(given).withColumn("entity_type", kinds)
    got = {r.transaction_id: r for r in by_customer(txn, features.usual_amounts, **sizes).collect()}
    assert len(got) == len(given)
    kind = lambda r: r[1][3] < "5"
    hour = lambda r: r[2][11:13]
    for row in given:
        for name, key in [("category", kind), ("hour", hour)]:
            past = [r[3] for r in earlier(given, row) if key(r) == key(row)]
            want = 0.0
            if len(past) > 1 and (std := statistics.stdev(past)) > 0:
                want = (row[3] - statistics.mean(past)) / std
            # near a billion a mean is exact to 1e-7, against cents of spread
            assert got[row[1]][f"amount_deviation_{name}"] == pytest.approx(want, rel=1e-4 if large else 1e-9, abs=1e-4 if large else 1e-9)


@pytest.mark.parametrize("sizes", SIZES)
def test_habitual_place(payments, sizes):
    given = rows(0.0)
    txn = payments(given)
    city = {r.transaction_id: r.city for r in txn.collect()}
    got = {r.transaction_id: r.habitual_place_share for r in by_customer(txn, features.habitual_place, **sizes).collect()}
    assert len(got) == len(given)
    days = lambda a, b: (datetime.fromisoformat(a) - datetime.fromisoformat(b)).total_seconds() / 86_400
    for row in given:
        past = [(2 ** (-days(row[2], r[2]) / 30), city[r[1]] == city[row[1]]) for r in earlier(given, row)]
        if past:
            want = math.fsum(w for w, same in past if same) / math.fsum(w for w, _ in past)
            assert got[row[1]] == pytest.approx(want, rel=1e-9)
        else:
            assert got[row[1]] is None


def test_no_payments(payments):
    none = payments(rows(0.0)).withColumn("entity_type", F.lit("shop")).where("false")
    assert by_customer(none, features.usual_amounts).count() == 0
    assert by_customer(none, features.habitual_place).count() == 0
