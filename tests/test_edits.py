"""Account numbers near ones used earlier, against a comparison of all with all."""

import random

import pytest

from txnlens.operators.labels import edited_accounts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_against_all_pairs(payments, edits):
    rng = random.Random(edits)
    rows = []
    for k in range(400):
        base = rng.choice(["0012345678", "7", "55", "123456", "98127634508712349876", str(rng.randint(0, 99999))])
        number = list(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(number))
            number[at : at + rng.randint(0, 1)] = rng.choice(["", str(rng.randint(0, 9))])
        number = "".join(number) or "shop"
        # few different times, so that ids decide
        rows.append((rng.choice("AB"), f"t{k:03d}", f"2024-01-0{rng.randint(1, 4)} 00:00:00", 1.0, number))
    first, count = {}, {}
    for customer, key, time, _, number in rows:
        if number.isdigit():
            first[customer, number] = min(first.get((customer, number), (time, key)), (time, key))
            count[customer, number] = count.get((customer, number), 0) + 1
    want = {
        (c, new, old, distance(new, old), count[c, new], count[c, old])
        for c, new in first
        for d, old in first
        if c == d and first[d, old] < first[c, new] and distance(new, old) <= edits
    }
    found = edited_accounts(payments(rows), edits).collect()
    got = [(r.customer_id, r.recipient_entity, r.likely_recipient, r.edits, r.payments, r.likely_payments) for r in found]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    for r in found:
        assert str(r.first_seen) == first[r.customer_id, r.recipient_entity][0]
        assert str(r.likely_first_seen) == first[r.customer_id, r.likely_recipient][0]


def test_nothing_and_wrong_edits(payments):
    rows = payments([("A", "1", "2024-01-01 00:00:00", 1.0, "shop")])
    assert edited_accounts(rows).count() == 0
    assert edited_accounts(rows.where("false")).count() == 0
    with pytest.raises(ValueError):
        edited_accounts(rows, 3)
