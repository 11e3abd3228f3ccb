"""The same queries in SQL for DuckDB, as an independent check of the results."""

from __future__ import annotations

from txnlens.constants import (
    ACH,
    AMOUNT_RANGE,
    ANOMALY_SHARE,
    BANK_CITIES,
    BURST_CHILD_TYPES,
    BURST_GAP_SECONDS,
    BURST_MAX_CHILDREN,
    CITY_POPULATION,
    DIGIT_SHIFTS,
    ENTITY_POOLS,
    FEATURES,
    FLAGS,
    HIGH_AMOUNT_JITTER,
    HOUR_INTENSITY,
    LABEL,
    MONTH_DAY_INTENSITY,
    OTHER_AMOUNT_RANGE,
    TEST_SHARE,
    TRAIT_RANGE,
    TYPE_WEIGHT,
    TYPED_ENTITY_TYPES,
    WALLET,
    WEEKDAY_INTENSITY,
)

# --- pieces of SQL -----------------------------------------------------------------------------


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values: list) -> str:
    return "[" + ", ".join(text(v) if isinstance(v, str) else repr(v) for v in values) + "]"


def digest(seed: str, *keys: str) -> str:
    joined = ", ".join([text(seed), *keys])
    return f"CAST('0x' || substr(md5(concat_ws('|', {joined})), 1, 12) AS BIGINT)"


def draw(seed: str, *keys: str) -> str:
    return f"(CAST({digest(seed, *keys)} AS DOUBLE) / 281474976710656.0)"


def between(seed: str, bounds: tuple[float, float], *keys: str) -> str:
    low, high = bounds
    return f"({low!r} + {draw(seed, *keys)} * {high - low!r}::DOUBLE)"


def whole(seed: str, low: int, high: int, *keys: str) -> str:
    return f"CAST({low} + floor({draw(seed, *keys)} * {high - low + 1}) AS INT)"


def pick(values: list[str], u: str) -> str:
    return f"({array(values)})[CAST(floor({u} * {len(values)}) AS INT) + 1]"


def by_weight(weights: dict, u: str) -> str:
    total, running, cases = float(sum(weights.values())), 0.0, []
    *head, last = weights
    for value in head:
        running += weights[value]
        cases.append(f"WHEN {u} * {total!r}::DOUBLE < {running!r}::DOUBLE THEN {text(value)}")
    return f"CASE {' '.join(cases)} ELSE {text(last)} END"


def case(column: str, choices: dict[str, str], other: str = "NULL") -> str:
    cases = " ".join(f"WHEN {text(key)} THEN {value}" for key, value in choices.items())
    return f"CASE {column} {cases} ELSE {other} END"


def padded(number: str, width: int) -> str:
    as_text = f"CAST({number} AS VARCHAR)"
    return f"lpad({as_text}, CAST(greatest({width}, length({as_text})) AS INT), '0')"


def digits(seed: str, count: int, *keys: str) -> str:
    return f"lpad(CAST({digest(seed, *keys)} % {10**count} AS VARCHAR), {count}, '0')"


def trait(name: str, places: int, customer: str = "customer_id") -> str:
    return f"round({between(f'trait-{name}', TRAIT_RANGE[name], customer)}, {places})"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f')"


def rounded(columns: list[str], places: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {places}) AS {c}" for c in columns)


def chain(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# --- tables ------------------------------------------------------------------------------------

NO_FLAGS = ", ".join(f"0 AS {flag}" for flag in FLAGS)

TXN = f"""
ev AS (
  SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k,
         {by_weight(TYPE_WEIGHT, draw("type", "event_id"))} AS transaction_type
  FROM events),
txn AS (
  SELECT 'customer_' || {padded("user_id", 3)} AS customer_id,
         'customer_' || {padded("user_id", 3)} || '-' || {padded("event_id", 8)} AS transaction_id,
         ts AS timestamp, transaction_type, value AS amount, {NO_FLAGS},
         ({array(list(CITY_POPULATION))})[k % 20 + 1] AS city,
         CASE transaction_type WHEN {text(WALLET)} THEN 'Person-to-Person'
              WHEN {text(ACH)} THEN 'Friend/Family Transfer' ELSE event_type END AS entity_type,
         CASE transaction_type
              WHEN {text(WALLET)} THEN CAST(1000000000 + (user_id * 5 + k % 5) * 7919 AS VARCHAR)
              WHEN {text(ACH)} THEN CAST(70000000 + (user_id * 3 + k % 3) * 7919 AS VARCHAR)
              ELSE event_type END AS recipient_entity,
         recipient_entity AS original_recipient_entity
  FROM ev)"""

# All rows are one customer's.
ONE_CUSTOMER = (
    TXN.replace("txn AS (", "named AS (", 1)
    + """,
txn AS (SELECT * REPLACE ('default_customer' AS customer_id) FROM named)"""
)

FOREIGN = f"""
WITH places AS (
  SELECT s_suppkey, s_nationkey AS nation, TIMESTAMP '1900-01-01' AS valid_from FROM supplier
  UNION ALL
  SELECT s_suppkey, (s_nationkey + 1 + {whole("move-to", 0, 23, "s_suppkey")}) % 25,
         TIMESTAMP '1995-01-01' + to_days({whole("move-day", 0, 1000, "s_suppkey")})
  FROM supplier WHERE {draw("moves", "s_suppkey")} < 0.3),
placed AS (SELECT s_suppkey, n_name, valid_from FROM places JOIN nation ON nation = n_nationkey),
paid AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey) AS transaction_id, l_suppkey,
         o_orderdate::TIMESTAMP AS paid_at, n_name AS customer_country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT transaction_id, customer_country, n_name AS recipient_country,
       CAST(coalesce(customer_country <> n_name, false) AS INT) AS is_foreign_recipient
FROM paid ASOF LEFT JOIN placed ON l_suppkey = s_suppkey AND paid_at >= valid_from"""

ORDERS = f"""
txn AS (
  SELECT 'customer_' || {padded("o_custkey", 3)} AS customer_id,
         {padded("o_orderkey", 12)} AS transaction_id, o_orderdate AS timestamp,
         o_totalprice AS amount, {NO_FLAGS}, 'CITY_' || o_orderstatus AS city,
         o_orderpriority AS recipient_entity
  FROM orders)"""


RESENT = f"""
resent AS (
  SELECT * FROM txn UNION ALL BY NAME
  SELECT * REPLACE (
      timestamp + to_seconds({whole("resend-gap", 1, 120, "transaction_id")}) AS timestamp,
      transaction_id || '-R' AS transaction_id)
  FROM txn WHERE {draw("resend", "transaction_id")} < {ANOMALY_SHARE})"""

_MOST = case("transaction_type", {k: repr(v[1]) for k, v in AMOUNT_RANGE.items()},
             repr(OTHER_AMOUNT_RANGE[1]))
_LEAST = case("transaction_type", {k: repr(v[0]) for k, v in AMOUNT_RANGE.items()},
              repr(OTHER_AMOUNT_RANGE[0]))


def _shifted(value: str, turn: int) -> str:
    place = f"(CAST(floor({draw(f'typo-place-{turn}', 'transaction_id')} * length({value})) AS INT) + 1)"
    step = f"({array(DIGIT_SHIFTS)})[CAST(floor({draw(f'typo-shift-{turn}', 'transaction_id')} * {len(DIGIT_SHIFTS)}) AS INT) + 1]"
    digit = f"CAST((CAST(substr({value}, {place}, 1) AS INT) + {step} + 10) % 10 AS VARCHAR)"
    return f"substr({value}, 1, {place} - 1) || {digit} || substr({value}, {place} + 1)"


_ENTITY_OF_CHILD = case(
    "transaction_type",
    {k: pick(list(ENTITY_POOLS[k]), draw("child-entity", "parent_id", "n")) for k in BURST_CHILD_TYPES},
)
_RECIPIENT_OF_CHILD = case(
    "entity_type",
    {
        entity: pick(names, draw("child-recipient", "parent_id", "n"))
        for k in BURST_CHILD_TYPES
        for entity, names in ENTITY_POOLS[k].items()
    },
)
_LATER = " + ".join(
    f"CASE WHEN n >= {i} THEN {between(f'child-gap-{i}', BURST_GAP_SECONDS, 'parent_id')} ELSE 0 END"
    for i in range(1, BURST_MAX_CHILDREN + 1)
)

BURSTS = f"""
m1 AS (
  SELECT * REPLACE (CAST({draw("burst", "transaction_id")} < {trait("burst", 4)} AS INT)
                    AS is_accident_burst) FROM txn)"""

HIGH = f"""
m2 AS (
  SELECT * REPLACE (
    CAST(is_accident_burst = 0 AND {draw("high", "transaction_id")} < {trait("high", 4)} AS INT)
      AS is_high_amount_accident,
    CASE WHEN is_accident_burst = 0 AND {draw("high", "transaction_id")} < {trait("high", 4)}
         THEN round({_MOST} * {trait("multiplier", 2)}
                    * {between("high-jitter", HIGH_AMOUNT_JITTER, "transaction_id")}, 2)
         ELSE amount END AS amount) FROM m1)"""

TYPOS = f"""
m3a AS (
  SELECT *, is_accident_burst = 0 AND is_high_amount_accident = 0
     AND entity_type IN ({", ".join(map(text, TYPED_ENTITY_TYPES))})
     AND regexp_full_match(recipient_entity, '[0-9]+')
     AND {draw("typo", "transaction_id")} < {trait("typo", 4)} AS hit,
     CASE WHEN hit THEN {_shifted("recipient_entity", 1)} END AS once FROM m2),
m3 AS (
  SELECT * EXCLUDE (hit, once) REPLACE (
     CAST(hit AS INT) AS is_mistyped_entity_accident,
     CASE WHEN NOT hit THEN recipient_entity
          WHEN {whole("typo-count", 1, 2, "transaction_id")} = 2 THEN {_shifted("once", 2)}
          ELSE once END AS recipient_entity,
     recipient_entity AS original_recipient_entity) FROM m3a)"""


def children(source: str) -> str:
    return f"""
kids0 AS (
  SELECT *, transaction_id AS parent_id,
         unnest(range(1, 1 + least({whole("children", 1, BURST_MAX_CHILDREN, "transaction_id")},
           {whole("trait-children", 1, BURST_MAX_CHILDREN, "customer_id")}))) AS n
  FROM {source} WHERE is_accident_burst = 1),
kids1 AS (
  SELECT * REPLACE ({pick(BURST_CHILD_TYPES, draw("child-type", "parent_id", "n"))} AS transaction_type,
    make_timestamp(epoch_us(timestamp) + CAST(round(({_LATER}) * 1000000) AS BIGINT)) AS timestamp,
    parent_id || '-A' || n AS transaction_id) FROM kids0),
kids2 AS (
  SELECT * REPLACE ({_ENTITY_OF_CHILD} AS entity_type,
    round({_LEAST} + {draw("child-amount", "parent_id", "n")} * ({_MOST} - {_LEAST}), 2) AS amount)
  FROM kids1),
kids3 AS (
  SELECT * EXCLUDE (parent_id, n) REPLACE ({_RECIPIENT_OF_CHILD} AS recipient_entity) FROM kids2),
acc AS (
  SELECT * FROM {source} UNION ALL BY NAME
  SELECT * REPLACE (recipient_entity AS original_recipient_entity) FROM kids3)"""


ACCIDENTS = ",".join([TXN, BURSTS, HIGH, TYPOS, children("m3")])

_SOD = "(hour(timestamp) * 3600 + minute(timestamp) * 60 + CAST(second(timestamp) AS INT))"
_LABEL = "greatest(" + ", ".join(FLAGS) + ")"


def features(source: str) -> str:
    return f"""
f0 AS (SELECT *, epoch_us(timestamp) AS us, {_SOD} AS sod FROM {source}),
f1 AS (
  SELECT *,
    avg(amount) OVER (span RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS mean_24hr,
    max(amount) OVER (span RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS max_amount_7day,
    stddev_samp(amount) OVER (span RANGE BETWEEN 2591999999999 PRECEDING AND CURRENT ROW)
      AS stddev_30day,
    coalesce((us - lag(us) OVER seq) / 1000000.0::DOUBLE, -1.0) AS time_since_last_txn,
    avg(amount) OVER (pay ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS mean_amount_rolling,
    stddev_samp(amount) OVER (pay ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS std_amount_rolling,
    CAST(us = min(us) OVER (PARTITION BY customer_id, recipient_entity) AS INT) AS is_new_recipient,
    CAST(coalesce(us - lag(us) OVER (PARTITION BY customer_id, recipient_entity, amount
      ORDER BY us, transaction_id) BETWEEN 1 AND 60000000, FALSE) AS INT)
      AS is_duplicate_transaction_within_X_minutes,
    abs(sod - avg(sod) OVER (pay ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      AS time_deviation_from_user_norm,
    CAST(row_number() OVER (PARTITION BY customer_id, city ORDER BY us, transaction_id) = 1 AS INT)
      AS is_unusual_location_for_user,
    CAST(hour(timestamp) AS INT) AS hour_of_day, CAST(isodow(timestamp) - 1 AS INT) AS day_of_week,
    CAST(day(timestamp) AS INT) AS day_of_month, CAST(month(timestamp) AS INT) AS month_of_year,
    CAST(isodow(timestamp) >= 6 AS INT) AS is_weekend, {_LABEL} AS {LABEL}
  FROM f0
  WINDOW span AS (PARTITION BY customer_id ORDER BY us),
         seq AS (PARTITION BY customer_id ORDER BY us, transaction_id),
         pay AS (PARTITION BY customer_id, recipient_entity ORDER BY us, transaction_id)),
feat AS (
  SELECT *, CASE WHEN std_amount_rolling > 0
    THEN (amount - mean_amount_rolling) / std_amount_rolling ELSE 0 END AS amount_deviation_rolling
  FROM f1)"""


_DOUBLES = [
    "amount",
    "mean_24hr",
    "stddev_30day",
    "max_amount_7day",
    "time_since_last_txn",
    "mean_amount_rolling",
    "std_amount_rolling",
    "amount_deviation_rolling",
    "time_deviation_from_user_norm",
]
_INTS = [c for c in FEATURES if c not in _DOUBLES]
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)

SCORED = f"""{ACCIDENTS}, {features("acc")},
sc0 AS (
  SELECT *, CASE WHEN time_since_last_txn BETWEEN 0 AND 5 THEN 0.9::DOUBLE
      WHEN amount_deviation_rolling >= 4 THEN 0.7::DOUBLE
      WHEN amount_deviation_rolling >= 2.5 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END
      AS accident_probability
  FROM feat WHERE {_COMPLETE}),
scored AS (
  SELECT *, CAST(accident_probability >= 0.5 AS INT) AS predicted_accident,
    CASE WHEN accident_probability >= 0.8 THEN 'High'
         WHEN accident_probability >= 0.6 THEN 'Medium' ELSE 'Low' END AS risk FROM sc0),
cells AS (
  SELECT count(*) FILTER ({LABEL} = 0 AND predicted_accident = 0) AS tn,
         count(*) FILTER ({LABEL} = 0 AND predicted_accident = 1) AS fp,
         count(*) FILTER ({LABEL} = 1 AND predicted_accident = 0) AS fn,
         count(*) FILTER ({LABEL} = 1 AND predicted_accident = 1) AS tp FROM scored)"""

_PHONE = digits("phone", 10, "customer_id")

BANK = f"""
bank AS (
  SELECT 'customer_' || {padded("user_id", 3)} AS customer_id,
         'customer_' || {padded("user_id", 3)} || '-' || {padded("event_id", 8)} AS transaction_id,
         CAST((epoch_us(ts) - 1704067200000000) // 600000000 AS INT) AS step, value AS amount,
         {pick(BANK_CITIES, draw("bank-city", "customer_id"))} AS city,
         '+1 (' || substr({_PHONE}, 1, 3) || ') ' || substr({_PHONE}, 4, 3) || '-'
           || substr({_PHONE}, 7, 4) AS receiver_phone
  FROM events),
bank1 AS (
  SELECT * EXCLUDE (place, other) REPLACE (
    CASE WHEN place <= floor(total * {ANOMALY_SHARE}) THEN
      ({array(BANK_CITIES)})[other + CAST(other >= list_position({array(BANK_CITIES)}, city) AS INT)]
      ELSE city END AS city),
    place <= floor(total * {ANOMALY_SHARE}) AS is_location_anomaly
  FROM (SELECT *, count(*) OVER () AS total,
          CAST(floor({draw("other-city", "transaction_id")} * 6) AS INT) + 1 AS other,
          row_number() OVER (ORDER BY {digest("location", "transaction_id")}, transaction_id) AS place
        FROM bank)),
bank2 AS (
  SELECT * EXCLUDE (place, total) REPLACE (
    CASE WHEN place <= floor(total * {ANOMALY_SHARE})
         THEN '+1' || {digits("new-phone", 10, "transaction_id")} ELSE receiver_phone END
    AS receiver_phone)
  FROM (SELECT *,
          row_number() OVER (ORDER BY {digest("phone-anomaly", "transaction_id")}, transaction_id)
            AS place FROM bank1)),
phones AS (
  SELECT customer_id, '+1' || {_PHONE} AS expected_phone
  FROM (SELECT DISTINCT customer_id FROM bank) WHERE {draw("enrolled", "customer_id")} < 0.9),
checked AS (
  SELECT bank2.*, expected_phone,
    expected_phone IS NULL OR '+1' || right(regexp_replace(receiver_phone, '[^0-9]', '', 'g'), 10)
      <> expected_phone AS is_phone_mismatch,
    avg(amount) OVER (PARTITION BY customer_id) AS mean_amount
  FROM bank2 LEFT JOIN phones USING (customer_id))"""


def _reach() -> str:
    names, running, cases = list(CITY_POPULATION), 0, []
    for rank, name in enumerate(names, 1):
        running += CITY_POPULATION[name]
        cases.append(
            f"WHEN reach < {running} - CASE WHEN place <= {rank} THEN people ELSE 0 END "
            f"THEN {text(name)}"
        )
    return "CASE " + " ".join(cases) + " END"


HOMED = f"""{TXN},
h1 AS (
  SELECT *, {by_weight(CITY_POPULATION, draw("home", "customer_id"))} AS home_city,
    list_position({array(list(CITY_POPULATION))}, home_city) AS place,
    ({array(list(CITY_POPULATION.values()))})[place] AS people,
    {draw("away", "transaction_id")} * ({sum(CITY_POPULATION.values())} - people) AS reach FROM txn),
homed AS (
  SELECT customer_id, home_city, CASE WHEN {draw("stay", "transaction_id")} < {trait("home", 4)}
    THEN home_city ELSE {_reach()} END AS city FROM h1)"""


def _intensity(table: dict, key: str, other: float) -> str:
    cases = " ".join(f"WHEN {k} THEN {v!r}::DOUBLE" for k, v in table.items())
    return f"CASE {key} {cases} ELSE {other!r}::DOUBLE END"


def _plain(name: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in name).lower()


def _one_hot() -> str:
    levels = {
        "transaction_type": sorted(TYPE_WEIGHT),
        "city": sorted(CITY_POPULATION),
        "entity_type": sorted([*TYPED_ENTITY_TYPES, "click", "error", "purchase", "signup", "view"]),
    }
    columns = [
        f"CAST({column} = {text(level)} AS INT) AS {_plain(f'{column}_{level}')}"
        for column, values in levels.items()
        for level in values[1:]
    ]
    return "SELECT transaction_id, " + ", ".join(columns) + " FROM txn"


def _ratio(part: str, of: str) -> str:
    return f"coalesce(({part})::DOUBLE / nullif({of}, 0), 0)"


def _report() -> str:
    p0, r0, f0 = _ratio("tn", "tn+fn"), _ratio("tn", "tn+fp"), _ratio("2*tn", "2*tn+fn+fp")
    p1, r1, f1 = _ratio("tp", "tp+fp"), _ratio("tp", "tp+fn"), _ratio("2*tp", "2*tp+fp+fn")
    n = "tn+fp+fn+tp"
    acc = _ratio("tn+tp", n)
    lines = [
        ("0", p0, r0, f0, "tn+fp"),
        ("1", p1, r1, f1, "tp+fn"),
        ("accuracy", acc, acc, acc, n),
        ("macro avg", *[f"({a} + {b}) / 2" for a, b in ((p0, p1), (r0, r1), (f0, f1))], n),
        (
            "weighted avg",
            *[
                _ratio(f"{a} * (tn+fp) + {b} * (tp+fn)", n)
                for a, b in ((p0, p1), (r0, r1), (f0, f1))
            ],
            n,
        ),
    ]
    return " UNION ALL ".join(
        f"SELECT {text(name)} AS class, round({p}, 4) AS precision, round({r}, 4) AS recall, "
        f"round({f}, 4) AS f1, CAST({s} AS BIGINT) AS support FROM cells"
        for name, p, r, f, s in lines
    )


_TXN_COLUMNS = (
    "customer_id, transaction_id, transaction_type, amount, is_accident_burst, "
    "is_high_amount_accident, is_mistyped_entity_accident, city, entity_type, recipient_entity, "
    "original_recipient_entity"
)


def _feature(columns: list[str], doubles: bool, *parts: str, source: str = "txn") -> str:
    chosen = rounded(columns) if doubles else ", ".join(columns)
    return chain(*parts, features(source), select=f"SELECT transaction_id, {chosen} FROM feat")


def _feature_table(source: str, places: int) -> str:
    return chain(
        source,
        features("txn"),
        select=f"SELECT customer_id, transaction_id, {rounded(_DOUBLES, places)}, "
        f"{', '.join(_INTS)}, {LABEL} FROM feat",
    )


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    flag_sums = ", ".join(f"CAST(coalesce(sum({f}), 0) AS BIGINT) AS {f}" for f in FLAGS)
    scale = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in FEATURES)
    scaled = ", ".join(
        f"round(({c} - mean_{c}) / CASE WHEN std_{c} = 0 THEN 1 ELSE std_{c} END, 5) AS {c}"
        for c in FEATURES
    )
    queries = {
        "csv_roundtrip": chain(TXN, select=f"SELECT {_TXN_COLUMNS}, {iso('timestamp')} AS timestamp FROM txn"),
        "ensure_columns": chain(
            TXN,
            select=f"""SELECT transaction_id, amount, {NO_FLAGS},
              '2024-01-01T00:00:00.000000' AS timestamp, 'default_customer' AS customer_id,
              'default_recipient' AS recipient_entity, 'default_city' AS city FROM txn""",
        ),
        "normalize_txn": chain(
            ACCIDENTS,
            select=f"""SELECT transaction_id, epoch_us(timestamp) AS timestamp,
              CASE WHEN amount <= 100 THEN amount END AS amount, {', '.join(FLAGS)} FROM acc""",
        ),
        "filter_accidents": chain(
            ACCIDENTS,
            select="""SELECT customer_id, epoch_us(timestamp) AS us, transaction_type, amount,
              recipient_entity, original_recipient_entity FROM acc
              WHERE is_mistyped_entity_accident = 1""",
        ),
        "complete_rows": chain(
            TXN, features("txn"), select=f"SELECT transaction_id FROM feat WHERE {_COMPLETE}"
        ),
        "preview_txn": chain(
            TXN,
            select="""SELECT transaction_id, amount, city FROM txn
              ORDER BY timestamp DESC, transaction_id DESC LIMIT 10""",
        ),
        "null_profile": chain(
            TXN,
            select=" UNION ALL ".join(
                f"SELECT {text(name)} AS column_name, {text(kind)} AS data_type, "
                f"count({value}) AS non_null, count(*) - count({value}) AS missing FROM txn"
                for name, kind, value in [
                    ("customer_id", "string", "customer_id"),
                    ("transaction_type", "string", "transaction_type"),
                    ("amount", "double", "CASE WHEN amount < 100 THEN amount END"),
                    ("city", "string", "nullif(city, 'New York')"),
                    ("is_accident_burst", "int", "is_accident_burst"),
                ]
            ),
        ),
        "calendar_features": _feature(
            ["hour_of_day", "day_of_week", "day_of_month", "month_of_year", "is_weekend"], False, TXN
        ),
        "calendar_intensity": chain(
            TXN,
            select=f"""SELECT transaction_id, round(
              {_intensity(HOUR_INTENSITY, 'hour(timestamp)', 0.01)}
              * {_intensity(WEEKDAY_INTENSITY, 'isodow(timestamp) - 1', 1.0)}
              * {_intensity(MONTH_DAY_INTENSITY, 'day(timestamp)', 1.0)}, 6) AS intensity FROM txn""",
        ),
        "step_to_timestamp": chain(
            BANK,
            select="""SELECT transaction_id, step,
              epoch_us(TIMESTAMP '2025-01-01' + to_minutes(step * 10)) AS us FROM bank""",
        ),
        "normalize_phone": r"""
            SELECT doc_id, phone,
              '+1' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS normal_phone
            FROM (SELECT doc_id, unnest(regexp_extract_all(text,
              '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')) AS phone FROM documents)""",
        "txn_per_day": chain(
            TXN, select="SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS n FROM txn GROUP BY 1"
        ),
        "txn_per_week": chain(
            TXN,
            select="""SELECT CAST(CAST(date_trunc('week', timestamp) AS DATE) AS VARCHAR) AS week,
              count(*) AS n FROM txn GROUP BY 1""",
        ),
        "txn_per_customer": chain(TXN, select="SELECT customer_id, count(*) AS n FROM txn GROUP BY 1"),
        "top_customers": chain(
            TXN, select="SELECT customer_id, count(*) AS n FROM txn GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20"
        ),
        "top_entity_types": chain(
            TXN, select="SELECT entity_type, count(*) AS n FROM txn GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5"
        ),
        "top_recipients": chain(
            TXN,
            select="SELECT recipient_entity, count(*) AS n FROM txn GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5",
        ),
        "distinct_customers": chain(TXN, select="SELECT DISTINCT customer_id FROM txn"),
        "flag_distribution": chain(
            ACCIDENTS,
            select=" UNION ALL ".join(
                f"SELECT {text(f)} AS metric, {f} AS value, count(*) AS n FROM acc GROUP BY {f}"
                for f in FLAGS
            ),
        ),
        "accident_totals": chain(
            ACCIDENTS,
            select=f"""SELECT {flag_sums}, CAST(sum({_LABEL}) AS BIGINT) AS accidents,
              count(*) AS rows, round(sum({_LABEL}) * 100.0::DOUBLE / count(*), 2) AS accident_percent
              FROM acc""",
        ),
        "amount_summary": chain(
            TXN,
            select="""SELECT count(amount) AS count, round(avg(amount), 6) AS mean,
              round(stddev_samp(amount), 6) AS std, min(amount) AS min,
              round(quantile_cont(amount, 0.25), 6) AS p25, round(quantile_cont(amount, 0.5), 6) AS p50,
              round(quantile_cont(amount, 0.75), 6) AS p75, max(amount) AS max FROM txn""",
        ),
        "na_drop_report": chain(
            TXN,
            features("txn"),
            select=f"SELECT count(*) AS rows_before, count(*) FILTER ({_COMPLETE}) AS rows_after FROM feat",
        ),
        "home_city_share": chain(
            HOMED,
            select="""SELECT customer_id, count(*) AS n, round(
              sum(CASE WHEN city = home_city THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 2)
              AS home_city_percent FROM homed GROUP BY 1""",
        ),
        "home_city_overall": chain(
            HOMED,
            select="""SELECT count(*) AS n, round(
              sum(CASE WHEN city = home_city THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 2)
              AS home_city_percent FROM homed""",
        ),
        "first_transfer": chain(
            TXN,
            select="""SELECT customer_id, recipient_entity, epoch_us(min(timestamp)) AS first_timestamp
              FROM txn GROUP BY 1, 2""",
        ),
        "amount_vs_mean": chain(
            TXN,
            select="""SELECT transaction_id, round(m, 6) AS mean_amount, amount > 2 * m AS above_2x,
              amount > 5 * m AS above_5x
              FROM (SELECT *, avg(amount) OVER (PARTITION BY customer_id) AS m FROM txn)""",
        ),
        "amount_gap_bins": chain(
            ACCIDENTS,
            features("acc"),
            select=f"""SELECT CAST(floor(amount / 50.0::DOUBLE) AS BIGINT) AS amount_bin,
              CAST(floor(time_since_last_txn / 21600.0::DOUBLE) AS BIGINT) AS gap_bin, {LABEL},
              count(*) AS n FROM feat GROUP BY 1, 2, 3""",
        ),
        "union_batches": chain(
            TXN,
            select="SELECT customer_id, count(*) AS n, round(sum(amount), 4) AS amount FROM txn GROUP BY 1",
        ),
        "mean_24hr": _feature(["mean_24hr"], True, TXN),
        "stddev_30day": _feature(["stddev_30day"], True, TXN),
        "max_amount_7day": _feature(["max_amount_7day"], True, TXN),
        "time_since_last_txn": _feature(["time_since_last_txn"], True, TXN),
        "recipient_rolling": _feature(["mean_amount_rolling", "std_amount_rolling"], True, TXN),
        "amount_deviation": _feature(["amount_deviation_rolling"], True, TXN),
        "is_new_recipient": _feature(["is_new_recipient"], False, ORDERS),
        "duplicate_within": _feature(
            ["is_duplicate_transaction_within_X_minutes"], False, TXN, RESENT, source="resent"
        ),
        "time_of_day_norm": _feature(["time_deviation_from_user_norm"], True, TXN),
        "first_seen_location": _feature(["is_unusual_location_for_user"], False, TXN),
        "target_label": chain(
            ACCIDENTS,
            select=f"SELECT transaction_id, {', '.join(FLAGS)}, {_LABEL} AS {LABEL} FROM acc",
        ),
        "labelled_payments": chain(
            ACCIDENTS,
            select=f"""SELECT transaction_id, epoch_us(timestamp) AS us, amount, recipient_entity,
              original_recipient_entity, {', '.join(FLAGS)}, {_LABEL} AS {LABEL} FROM acc""",
        ),
        "foreign_recipient": FOREIGN,
        "foreign_recipient_split": FOREIGN,
        "shift_audit": chain(
            TXN,
            """
rolled AS (
  SELECT *, avg(amount) OVER last30 AS mean, stddev_samp(amount) OVER last30 AS std,
         row_number() OVER (PARTITION BY customer_id, recipient_entity ORDER BY timestamp, transaction_id) AS n
  FROM txn
  WINDOW last30 AS (PARTITION BY customer_id, recipient_entity ORDER BY timestamp, transaction_id
                    ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
shifted AS (
  SELECT customer_id, recipient_entity, transaction_id, n,
         lag(customer_id) OVER whole AS from_customer, lag(recipient_entity) OVER whole AS from_recipient,
         lag(mean) OVER whole AS shifted_mean, lag(std) OVER whole AS shifted_std
  FROM rolled
  WINDOW whole AS (ORDER BY customer_id, recipient_entity, timestamp, transaction_id))""",
            select="""SELECT customer_id, recipient_entity, transaction_id, from_customer, from_recipient,
              round(shifted_mean, 6) AS shifted_mean, round(shifted_std, 6) AS shifted_std
            FROM shifted WHERE n = 1 AND shifted_mean IS NOT NULL""",
        ),
        "feature_table": _feature_table(TXN, 6),
        "feature_table_orders": _feature_table(ORDERS, 4),
        "feature_table_split": _feature_table(TXN, 8),
        "feature_table_default_customer": _feature_table(ONE_CUSTOMER, 6)
        .replace("AS DOUBLE), 6)", "AS DOUBLE) + 3e-7, 6)")
        .replace(
            "round(CAST(time_deviation_from_user_norm AS DOUBLE) + 3e-7, 6)",
            "round(CAST(time_deviation_from_user_norm AS DOUBLE) + 3e-5, 3)",
        ),
        "inject_burst": chain(
            TXN,
            BURSTS,
            children("m1"),
            select="""SELECT customer_id, transaction_id, epoch_us(timestamp) AS us, transaction_type,
              amount, is_accident_burst, city, entity_type, recipient_entity FROM acc""",
        ),
        "inject_high_amount": chain(
            TXN,
            BURSTS,
            HIGH,
            select="SELECT transaction_id, amount, is_accident_burst, is_high_amount_accident FROM m2",
        ),
        "inject_typo": chain(
            TXN,
            BURSTS,
            HIGH,
            TYPOS,
            select="""SELECT transaction_id, recipient_entity, original_recipient_entity,
              is_mistyped_entity_accident FROM m3""",
        ),
        "inject_location": chain(
            BANK, select="SELECT transaction_id, city, is_location_anomaly FROM bank1"
        ),
        "sample_rows": chain(
            TXN,
            select=f"""SELECT transaction_id FROM (SELECT transaction_id, count(*) OVER () AS n,
              row_number() OVER (ORDER BY {digest("sample", "transaction_id")}, transaction_id) AS place
              FROM txn) WHERE place <= floor(n * {ANOMALY_SHARE})""",
        ),
        "sticky_attribute": chain(
            BANK, select=f"SELECT transaction_id, city, '+1' || {_PHONE} AS phone FROM bank"
        ),
        "weighted_pick": chain(
            TXN,
            select=f"""SELECT transaction_id,
              {by_weight(CITY_POPULATION, draw("pick-city", "transaction_id"))} AS city,
              {by_weight(TYPE_WEIGHT, draw("pick-type", "transaction_id"))} AS kind FROM txn""",
        ),
        "phone_mismatch": chain(
            BANK,
            select="SELECT transaction_id, receiver_phone, expected_phone, is_phone_mismatch FROM checked",
        ),
        "rule_label": chain(
            BANK,
            select="""SELECT transaction_id, amount > 5 * mean_amount AS is_high_amount,
              is_location_anomaly, is_phone_mismatch,
              amount > 5 * mean_amount OR is_location_anomaly OR is_phone_mismatch AS is_accident
              FROM checked""",
        ),
        "rule_counts": chain(
            BANK,
            select="""SELECT count(*) FILTER (amount > 2 * mean_amount) AS high_amount,
              count(*) FILTER (is_location_anomaly) AS location,
              count(*) FILTER (is_phone_mismatch) AS phone,
              count(*) FILTER (amount > 2 * mean_amount OR is_location_anomaly OR is_phone_mismatch)
                AS accidents, count(*) AS rows FROM checked""",
        ),
        "burst_groups": chain(
            ACCIDENTS,
            """
g1 AS (
  SELECT *, epoch_us(timestamp) AS us, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER
    (PARTITION BY customer_id ORDER BY timestamp, transaction_id) AS gap FROM acc),
g2 AS (
  SELECT *, sum(CASE WHEN gap <= 5000000 THEN 0 ELSE 1 END) OVER
    (PARTITION BY customer_id ORDER BY us, transaction_id ROWS UNBOUNDED PRECEDING) AS g FROM g1)""",
            select="""SELECT customer_id, min(us) AS started_at, max(us) AS ended_at,
              count(*) AS payments, round(sum(amount), 6) AS total_amount
              FROM g2 GROUP BY customer_id, g HAVING count(*) > 1""",
        ),
        "typo_candidates": chain(
            ACCIDENTS,
            """
a AS (
  SELECT customer_id, recipient_entity AS r, epoch_us(min(timestamp)) AS seen, count(*) AS n
  FROM acc WHERE regexp_full_match(recipient_entity, '[0-9]+') GROUP BY 1, 2)""",
            select="""SELECT w.customer_id, w.r AS recipient_entity, o.r AS likely_recipient,
              w.seen AS first_seen, o.seen AS likely_first_seen,
              CAST(hamming(w.r, o.r) AS INT) AS digits_off, w.n AS payments, o.n AS likely_payments
              FROM a w JOIN a o ON w.customer_id = o.customer_id AND length(w.r) = length(o.r)
                AND o.seen < w.seen
              WHERE hamming(w.r, o.r) <= 2""",
        ),
        "edited_accounts": chain(
            ACCIDENTS,
            """
a AS (
  SELECT customer_id, recipient_entity AS r, min({'at': timestamp, 'id': transaction_id}) AS f, count(*) AS n
  FROM acc WHERE regexp_full_match(recipient_entity, '[0-9]+') GROUP BY 1, 2)""",
            select="""SELECT w.customer_id, w.r AS recipient_entity, o.r AS likely_recipient,
              epoch_us(w.f.at) AS first_seen, epoch_us(o.f.at) AS likely_first_seen,
              CAST(levenshtein(w.r, o.r) AS INT) AS edits, w.n AS payments, o.n AS likely_payments
              FROM a w JOIN a o ON w.customer_id = o.customer_id AND o.f < w.f
              WHERE levenshtein(w.r, o.r) <= 2""",
        ),
        "confusion_matrix": chain(
            SCORED,
            select=" UNION ALL ".join(
                f"SELECT {a} AS actual, {p} AS predicted, {cell} AS n FROM cells"
                for a, p, cell in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
            ),
        ),
        "classification_report": chain(SCORED, select=_report()),
        "recall": chain(
            SCORED,
            select=f"""SELECT tp + fn AS actual, tp AS found, round({_ratio("tp", "tp+fn")}, 4) AS recall
              FROM cells""",
        ),
        "risk_band": chain(
            TXN,
            select=f"""SELECT transaction_id, p AS probability, CASE WHEN p >= 0.8 THEN 'High'
              WHEN p >= 0.6 THEN 'Medium' ELSE 'Low' END AS risk
              FROM (SELECT transaction_id, round({draw("risk", "transaction_id")}, 4) AS p FROM txn)""",
        ),
        "risk_summary": chain(
            SCORED,
            select="""SELECT 'Total' AS risk, count(*) AS n FROM scored WHERE predicted_accident = 1
              UNION ALL SELECT b, (SELECT count(*) FROM scored WHERE predicted_accident = 1 AND risk = b)
              FROM (VALUES ('High'), ('Medium'), ('Low')) t(b)""",
        ),
        "flagged_json": chain(
            SCORED,
            select=f"""SELECT '{{"timestamp":"' || {iso("timestamp")} || '","customer_id":"'
              || customer_id || '","amount":' || CAST(amount AS VARCHAR) || ',"recipient_entity":"'
              || recipient_entity || '","city":"' || city || '","accident_probability":'
              || CAST(accident_probability AS VARCHAR) || '}}' AS record
              FROM scored WHERE predicted_accident = 1""",
        ),
        "flagged_report": chain(
            SCORED,
            select="""SELECT customer_id, recipient_entity, city,
              '$' || format('{:,.2f}', amount) AS amount_text,
              strftime(timestamp, '%b %-d, %Y, %I:%M %p') AS date_text,
              printf('%.1f%%', accident_probability * 100) AS probability_text, risk
              FROM scored WHERE predicted_accident = 1""",
        ),
        "stratified_split": chain(
            ACCIDENTS,
            _split("acc", _LABEL),
            select=f"SELECT transaction_id, label AS {LABEL}, is_test FROM parts",
        ),
        "standardize": chain(
            ACCIDENTS,
            features("acc"),
            f"whole_rows AS (SELECT * FROM feat WHERE {_COMPLETE})",
            _split("whole_rows", LABEL),
            f"sc AS (SELECT {scale} FROM parts WHERE NOT is_test)",
            select=f"SELECT transaction_id, is_test, {scaled} FROM parts CROSS JOIN sc",
        ),
        "one_hot": chain(TXN, select=_one_hot()),
        "usual_amounts": chain(
            TXN,
            """
usual AS (
  SELECT transaction_id, amount, avg(amount) OVER c AS mean_c, stddev_samp(amount) OVER c AS std_c,
    avg(amount) OVER h AS mean_h, stddev_samp(amount) OVER h AS std_h
  FROM txn WINDOW
    c AS (PARTITION BY customer_id, entity_type ORDER BY timestamp, transaction_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    h AS (PARTITION BY customer_id, hour(timestamp) ORDER BY timestamp, transaction_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
            select="""SELECT transaction_id,
              round(CASE WHEN std_c > 0 THEN (amount - mean_c) / std_c ELSE 0 END, 6) AS amount_deviation_category,
              round(CASE WHEN std_h > 0 THEN (amount - mean_h) / std_h ELSE 0 END, 6) AS amount_deviation_hour
              FROM usual""",
        ),
        "habitual_place": chain(
            TXN,
            """
aged AS (
  SELECT a.transaction_id, a.city = b.city AS here,
    pow(2.0, (epoch_us(b.timestamp) - epoch_us(a.timestamp)) / (30 * 86400000000.0)) AS weight
  FROM txn a LEFT JOIN txn b ON a.customer_id = b.customer_id
    AND (b.timestamp, b.transaction_id) < (a.timestamp, a.transaction_id))""",
            select="""SELECT transaction_id,
              round(coalesce(sum(weight) FILTER (here), 0) / sum(weight), 6) AS habitual_place_share
              FROM aged GROUP BY transaction_id""",
        ),
        "model_checks": chain(
            ACCIDENTS,
            features("acc"),
            f"whole_rows AS (SELECT * FROM feat WHERE {_COMPLETE})",
            _split("whole_rows", LABEL),
            select=f"""SELECT p.transaction_id, a.customer_id, a.amount, a.recipient_entity, a.city,
              {", ".join(f"a.{flag}" for flag in FLAGS)}, label AS {LABEL}, true AS same_probability,
              true AS same_class, true AS parts_add_up, true AS same_nodes
              FROM parts p JOIN acc a USING (transaction_id) WHERE is_test""",
        ),
    }
    split = ["burst_groups", "usual_amounts", "habitual_place"]
    return {**queries, **{f"{name}_split": queries[name] for name in split}}


def _split(source: str, label: str) -> str:
    return f"""
ranked AS (
  SELECT *, {label} AS label, count(*) OVER (PARTITION BY {label}) AS stratum_rows,
    row_number() OVER (PARTITION BY {label}
      ORDER BY {digest("split-42", "transaction_id")}, transaction_id) AS place FROM {source}),
parts AS (SELECT *, place <= floor(stratum_rows * {TEST_SHARE} + 0.5) AS is_test FROM ranked)"""
