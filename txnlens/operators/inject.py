"""Put known accidents into a payment table, to test and train detectors.

Whether and how a row is changed depends only on hashes of its id and its customer, so a run can be
repeated and a lost task redone. A row has one kind of accident at most: a burst comes before a
high amount, and that before a mistyped recipient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.constants import (
    AMOUNT_RANGE,
    ANOMALY_SHARE,
    BURST_CHILD_TYPES,
    BURST_GAP_SECONDS,
    BURST_MAX_CHILDREN,
    CITY_POPULATION,
    DIGIT_SHIFTS,
    ENTITY_POOLS,
    HIGH_AMOUNT_JITTER,
    OTHER_AMOUNT_RANGE,
    TRAIT_RANGE,
    TYPED_ENTITY_TYPES,
)
from txnlens.functions.calendar import plus_seconds
from txnlens.functions.draws import (
    between,
    draw,
    phone_number,
    pick,
    trait,
    values_array,
    weighted_pick,
    whole,
)
from txnlens.functions.text import is_digits, shift_digit
from txnlens.operators.sampling import mark_share

ID = "transaction_id"
CUSTOMER = "customer_id"


def mark_bursts(txn: DataFrame) -> DataFrame:
    """Flag the payments that will be repeated in haste."""
    chance = trait("burst", TRAIT_RANGE["burst"], 4, CUSTOMER)
    return txn.withColumn("is_accident_burst", (draw("burst", ID) < chance).cast("int"))


def _by_type(column: Column, bound: int) -> Column:
    value = None
    for kind, limits in AMOUNT_RANGE.items():
        test = column == kind
        value = F.when(test, limits[bound]) if value is None else value.when(test, limits[bound])
    return value.otherwise(OTHER_AMOUNT_RANGE[bound])


def mark_high_amounts(txn: DataFrame) -> DataFrame:
    """Raise some amounts to a multiple of what is usual at most for their type."""
    chance = trait("high", TRAIT_RANGE["high"], 4, CUSTOMER)
    multiplier = trait("multiplier", TRAIT_RANGE["multiplier"], 2, CUSTOMER)
    most = _by_type(F.col("transaction_type"), 1)
    raised = F.round(most * multiplier * between("high-jitter", *HIGH_AMOUNT_JITTER, ID), 2)
    hit = (F.col("is_accident_burst") == 0) & (draw("high", ID) < chance)
    return txn.withColumn("is_high_amount_accident", hit.cast("int")).withColumn(
        "amount", F.when(F.col("is_high_amount_accident") == 1, raised).otherwise(F.col("amount"))
    )


def mark_typos(txn: DataFrame) -> DataFrame:
    """Change one or two digits of some account numbers; the right one is kept beside it.

    Two changes may hit the same digit and cancel out.
    """
    chance = trait("typo", TRAIT_RANGE["typo"], 4, CUSTOMER)
    hit = (
        (F.col("is_accident_burst") == 0)
        & (F.col("is_high_amount_accident") == 0)
        & F.col("entity_type").isin(TYPED_ENTITY_TYPES)
        & is_digits("recipient_entity")
        & (draw("typo", ID) < chance)
    )

    length = F.length("recipient_entity")
    places = [F.floor(draw(f"typo-place-{turn}", ID) * length).cast("int") for turn in (1, 2)]
    steps = [pick(DIGIT_SHIFTS, f"typo-shift-{turn}", ID) for turn in (1, 2)]
    twice = whole("typo-count", 1, 2, ID) == 2

    def change(digit: Column, at: Column) -> Column:
        first = F.when(at == places[0], steps[0]).otherwise(0)
        second = F.when(twice & (at == places[1]), steps[1]).otherwise(0)
        return shift_digit(digit, first + second)

    # The account number is named once: a filter on the result repeats all of this expression.
    digits = F.regexp_extract_all("recipient_entity", F.lit("([0-9])"), F.lit(1))
    typed = F.array_join(F.transform(digits, change), "")
    wrong = F.col("is_mistyped_entity_accident") == 1
    return txn.withColumns(
        {
            "is_mistyped_entity_accident": hit.cast("int"),
            "original_recipient_entity": F.col("recipient_entity"),
        }
    ).withColumn(
        "recipient_entity", F.when(wrong, typed).otherwise(F.col("recipient_entity"))
    )


def burst_children(txn: DataFrame) -> DataFrame:
    """The one to three payments that follow each flagged one within seconds.

    Each comes 0.01 to 5 seconds after the one before, in the same city, with a type, recipient
    and amount of its own.
    """
    most = whole("trait-children", 1, BURST_MAX_CHILDREN, CUSTOMER)
    count = F.least(whole("children", 1, BURST_MAX_CHILDREN, ID), most)
    n = F.col("_child")
    gaps = [between(f"child-gap-{i}", *BURST_GAP_SECONDS, ID) for i in range(1, BURST_MAX_CHILDREN + 1)]
    later = gaps[0]
    for i, gap in enumerate(gaps[1:], 2):
        later = later + F.when(n >= i, gap).otherwise(0.0)

    def choose(choices: dict[str, Column], of: str) -> Column:
        value = None
        for name, choice in choices.items():
            test = F.col(of) == name
            value = F.when(test, choice) if value is None else value.when(test, choice)
        return value

    entity_types = {
        kind: pick(list(ENTITY_POOLS[kind]), "child-entity", ID, "_child")
        for kind in BURST_CHILD_TYPES
    }
    recipients = {
        entity: pick(names, "child-recipient", ID, "_child")
        for kind in BURST_CHILD_TYPES
        for entity, names in ENTITY_POOLS[kind].items()
    }
    low, high = _by_type(F.col("transaction_type"), 0), _by_type(F.col("transaction_type"), 1)
    return (
        txn.where("is_accident_burst = 1")
        .withColumn("_child", F.explode(F.sequence(F.lit(1), count)))
        .withColumns(
            {
                "transaction_type": pick(BURST_CHILD_TYPES, "child-type", ID, "_child"),
                "timestamp": plus_seconds("timestamp", later),
            }
        )
        .withColumns(
            {
                "entity_type": choose(entity_types, "transaction_type"),
                "amount": F.round(low + draw("child-amount", ID, "_child") * (high - low), 2),
            }
        )
        .withColumn("recipient_entity", choose(recipients, "entity_type"))
        .withColumns(
            {
                "original_recipient_entity": F.col("recipient_entity"),
                ID: F.concat(ID, F.lit("-A"), n.cast("string")),
            }
        )
        .drop("_child")
    )


def inject_bursts(txn: DataFrame) -> DataFrame:
    """Flag payments and add what follows them."""
    marked = mark_bursts(txn)
    return marked.unionByName(burst_children(marked))


def inject_accidents(txn: DataFrame) -> DataFrame:
    """All three kinds of accident."""
    marked = mark_typos(mark_high_amounts(mark_bursts(txn)))
    return marked.unionByName(burst_children(marked))


def home_city(customer: str = CUSTOMER) -> Column:
    """The customer's home, drawn by population: the same customer always has the same."""
    return weighted_pick(CITY_POPULATION, "home", customer)


def with_usual_city(txn: DataFrame) -> DataFrame:
    """Draw each payment's city: mostly the customer's home, else another one by its population."""
    names = list(CITY_POPULATION)
    place = F.array_position(values_array(names), F.col("_home")).cast("int")
    people = F.element_at(values_array(list(CITY_POPULATION.values())), F.col("_place"))
    # Running totals without the home city, which therefore is never reached.
    reach = draw("away", ID) * (F.lit(sum(CITY_POPULATION.values())) - F.col("_people"))
    away, running = None, 0
    for rank, name in enumerate(names, 1):
        running += CITY_POPULATION[name]
        at_home = F.when(F.col("_place") <= rank, F.col("_people")).otherwise(0)
        test = F.col("_reach") < F.lit(running) - at_home
        away = F.when(test, name) if away is None else away.when(test, name)
    stays = draw("stay", ID) < trait("home", TRAIT_RANGE["home"], 4, CUSTOMER)
    return (
        txn.withColumn("_home", home_city())
        .withColumn("_place", place)
        .withColumn("_people", people)
        .withColumn("_reach", reach)
        .withColumn("city", F.when(stays, F.col("_home")).otherwise(away))
        .drop("_home", "_place", "_people", "_reach")
    )


def inject_locations(
    df: DataFrame, cities: list[str], column: str = "city", share: float = ANOMALY_SHARE
) -> DataFrame:
    """Give a share of the rows another city than their own and flag them."""
    others = F.array_except(values_array(cities), F.array(column))
    place = F.floor(draw("other-city", ID) * F.size(others)).cast("int") + 1
    return mark_share(df, "is_location_anomaly", "location", share).withColumn(
        column,
        F.when(F.col("is_location_anomaly"), F.element_at(others, place)).otherwise(F.col(column)),
    )


def inject_phones(
    df: DataFrame,
    column: str = "receiver_phone",
    share: float = ANOMALY_SHARE,
    base: DataFrame | None = None,
) -> DataFrame:
    """Give a share of the rows another phone number."""
    return (
        mark_share(df, "_phone", "phone-anomaly", share, base)
        .withColumn(
            column, F.when(F.col("_phone"), phone_number("new-phone", ID)).otherwise(F.col(column))
        )
        .drop("_phone")
    )
