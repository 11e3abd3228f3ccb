"""The queries by name. Each takes (spark, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.constants import BANK_CITIES, CITY_POPULATION, FEATURES, FLAGS, LABEL, TYPE_WEIGHT
from txnlens.functions.calendar import calendar_columns, intensity, iso_text, step_to_timestamp
from txnlens.functions.draws import draw, phone_number, pick, weighted_pick
from txnlens.functions.text import normalize_phone, risk_band
from txnlens.operators import audit, evaluate, features, foreign, inject, joins, labels, model, profile, sampling, trees
from txnlens.operators.prefix import before
from txnlens.operators.skew import by_customer, shared_folder, stage
from txnlens.operators.spans import span_columns
from txnlens.plans import label, train
from txnlens.plans.rules import rule_scores
from txnlens.plans.train import split_rows
from txnlens.schema import ensure_columns, normalize
from txnlens.sources import csv, tables
from txnlens.sources.publish import publish, read_published

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round fractions, so sums taken in another order compare equal."""
    return df.select(
        *[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


@cache
def _txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.txn_events(spark, sf_dir)


@cache
def _accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments with accidents put in: the plan is built once, nothing is kept of its rows."""
    return inject.inject_accidents(_txn(spark, sf_dir))


def _rule_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_scores(features.add_features(_accidents(spark, sf_dir)))


def _homed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.with_usual_city(_txn(spark, sf_dir))


# --- sources and cleaning ----------------------------------------------------------------------


@query
def csv_roundtrip(spark, sf_dir):
    path = f"{shared_folder(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    csv.write_csv(_txn(spark, sf_dir), path, by_day=True)
    back = csv.read_transactions(spark, path)
    return back.withColumn("timestamp", iso_text("timestamp"))


@query
def ensure_columns_query(spark, sf_dir):
    bare = _txn(spark, sf_dir).select("transaction_id", "amount")
    full = normalize(ensure_columns(bare))
    return full.withColumn("timestamp", iso_text("timestamp"))


@query
def normalize_txn(spark, sf_dir):
    raw = _accidents(spark, sf_dir).select(
        "transaction_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(F.col("amount") > 100, F.lit(float("nan"))).otherwise(F.col("amount")).alias("amount"),
        *[F.initcap((F.col(flag) == 1).cast("string")).alias(flag) for flag in FLAGS],
    )
    return normalize(raw).withColumn("timestamp", F.unix_micros("timestamp"))


@query
def filter_accidents(spark, sf_dir):
    hit = profile.filter_accidents(_accidents(spark, sf_dir), "is_mistyped_entity_accident")
    return hit.select(
        "customer_id",
        F.unix_micros("timestamp").alias("us"),
        "transaction_type",
        "amount",
        "recipient_entity",
        "original_recipient_entity",
    )


@query
def complete_rows(spark, sf_dir):
    featured = features.add_features(_txn(spark, sf_dir))
    return model.complete_rows(featured).select("transaction_id")


@query
def preview_txn(spark, sf_dir):
    txn = _txn(spark, sf_dir)
    return profile.preview_txn(txn, 10, last=True).select("transaction_id", "amount", "city")


@query
def null_profile(spark, sf_dir):
    bare = _txn(spark, sf_dir).select(
        "customer_id",
        "transaction_type",
        F.when(F.col("amount") < 100, F.col("amount")).alias("amount"),
        F.nullif("city", F.lit("New York")).alias("city"),
        "is_accident_burst",
    )
    return profile.null_profile(bare)


@query
def calendar_features(spark, sf_dir):
    txn = _txn(spark, sf_dir)
    return txn.withColumns(calendar_columns()).select("transaction_id", *calendar_columns())


@query
def calendar_intensity(spark, sf_dir):
    txn = _txn(spark, sf_dir)
    return rounded(txn.select("transaction_id", intensity().alias("intensity")))


@query
def step_to_timestamp_query(spark, sf_dir):
    bank = tables.bank_events(spark, sf_dir)
    at = F.unix_micros(step_to_timestamp("step"))
    return bank.select("transaction_id", "step", at.alias("us"))


@query
def normalize_phone_query(spark, sf_dir):
    pattern = F.lit(r"(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})")
    found = tables.table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", pattern, F.lit(1))).alias("phone")
    )
    return found.withColumn("normal_phone", normalize_phone("phone"))


# --- counts and summaries ----------------------------------------------------------------------


@query
def txn_per_day(spark, sf_dir):
    df = profile.txn_per_day(_txn(spark, sf_dir))
    return df.withColumn("day", F.col("day").cast("string"))


@query
def txn_per_week(spark, sf_dir):
    df = profile.txn_per_week(_txn(spark, sf_dir))
    return df.withColumn("week", F.col("week").cast("string"))


@query
def txn_per_customer(spark, sf_dir):
    return profile.txn_per_customer(_txn(spark, sf_dir))


@query
def top_customers(spark, sf_dir):
    return profile.top_customers(_txn(spark, sf_dir))


@query
def top_entity_types(spark, sf_dir):
    return profile.top_entity_types(_txn(spark, sf_dir))


@query
def top_recipients(spark, sf_dir):
    return profile.top_values(_txn(spark, sf_dir), "recipient_entity", 5)


@query
def distinct_customers(spark, sf_dir):
    return profile.distinct_customers(_txn(spark, sf_dir))


@query
def flag_distribution(spark, sf_dir):
    return profile.flag_distribution(_accidents(spark, sf_dir))


@query
def accident_totals(spark, sf_dir):
    return profile.accident_totals(_accidents(spark, sf_dir))


@query
def amount_summary(spark, sf_dir):
    return rounded(profile.number_summary(_txn(spark, sf_dir)))


@query
def na_drop_report(spark, sf_dir):
    featured = features.add_features(_txn(spark, sf_dir))
    return profile.drop_report(featured, FEATURES)


@query
def home_city_share(spark, sf_dir):
    return profile.home_city_share(_homed(spark, sf_dir), tables.home_cities(spark, sf_dir))


@query
def home_city_overall(spark, sf_dir):
    return profile.home_city_overall(_homed(spark, sf_dir), tables.home_cities(spark, sf_dir))


@query
def first_transfer(spark, sf_dir):
    first = joins.first_transfer(_txn(spark, sf_dir))
    return first.withColumn("first_timestamp", F.unix_micros("first_timestamp"))


@query
def amount_vs_mean(spark, sf_dir):
    df = joins.with_group_mean(_txn(spark, sf_dir))
    return rounded(
        df.select(
            "transaction_id",
            "mean_amount",
            *[labels.above_mean(k).alias(f"above_{k}x") for k in (2, 5)],
        )
    )


@query
def amount_gap_bins(spark, sf_dir):
    return profile.amount_gap_bins(features.add_features(_accidents(spark, sf_dir)))


@query
def union_batches(spark, sf_dir):
    days = _txn(spark, sf_dir).withColumn("_day", F.dayofmonth("timestamp"))
    early, late = days.where("_day <= 15"), days.where("_day > 15")
    both = late.unionByName(early)
    return both.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("amount")
    )


# --- history features --------------------------------------------------------------------------


def _feature_query(name, columns, build, source):
    def run(spark, sf_dir):
        txn = source(spark, sf_dir)
        slim = txn.select(
            "customer_id", "transaction_id", "timestamp", "amount", "recipient_entity", "city"
        )
        df = by_customer(slim, build)
        return rounded(df.select("transaction_id", *columns))

    run.__name__ = name
    QUERIES[name] = run


def _rolling(df):
    return features.recipient_rolling(before(df, features.recipient_payments()))


def _resent(spark, sf_dir):
    return tables.with_resends(_txn(spark, sf_dir))


def _simple(earlier, columns):
    """A feature of one group of earlier rows."""
    return lambda df: before(df, earlier()).withColumns(columns())


for _name, _columns, _build, _source in [
    *[
        (span, [span], lambda df, span=span: span_columns(df, [span]), _txn)
        for span in ("mean_24hr", "stddev_30day", "max_amount_7day")
    ],
    (
        "time_since_last_txn",
        ["time_since_last_txn"],
        _simple(features.last_payment, features.gap_columns),
        _txn,
    ),
    ("recipient_rolling", ["mean_amount_rolling", "std_amount_rolling"], _rolling, _txn),
    (
        "amount_deviation",
        ["amount_deviation_rolling"],
        lambda df: _rolling(df).withColumns(features.deviation_columns()),
        _txn,
    ),
    (
        "is_new_recipient",
        ["is_new_recipient"],
        _simple(features.recipient_payments, features.recipient_columns),
        tables.txn_orders,
    ),
    (
        "duplicate_within",
        ["is_duplicate_transaction_within_X_minutes"],
        _simple(features.same_payments, features.duplicate_columns),
        _resent,
    ),
    (
        "time_of_day_norm",
        ["time_deviation_from_user_norm"],
        _simple(features.recipient_payments, features.recipient_columns),
        _txn,
    ),
    (
        "first_seen_location",
        ["is_unusual_location_for_user"],
        _simple(features.city_payments, features.location_columns),
        _txn,
    ),
]:
    _feature_query(_name, _columns, _build, _source)


@query
def target_label(spark, sf_dir):
    df = features.target_label(_accidents(spark, sf_dir))
    return df.select("transaction_id", *FLAGS, LABEL)


def _usual_amounts(spark, sf_dir, **sizes):
    df = by_customer(_txn(spark, sf_dir), features.usual_amounts, **sizes)
    return rounded(df.select("transaction_id", "amount_deviation_category", "amount_deviation_hour"))


def _habitual_place(spark, sf_dir, **sizes):
    df = by_customer(_txn(spark, sf_dir), features.habitual_place, **sizes)
    return rounded(df.select("transaction_id", "habitual_place_share"))


@query
def usual_amounts(spark, sf_dir):
    return _usual_amounts(spark, sf_dir)


@query
def usual_amounts_split(spark, sf_dir):
    return _usual_amounts(spark, sf_dir, crowded_rows=0, chunk_rows=500)


@query
def habitual_place(spark, sf_dir):
    return _habitual_place(spark, sf_dir)


@query
def habitual_place_split(spark, sf_dir):
    return _habitual_place(spark, sf_dir, crowded_rows=0, chunk_rows=500)


def _foreign(spark, sf_dir, **sizes):
    txn = tables.supplier_payments(spark, sf_dir)
    homes, places = tables.customer_countries(spark, sf_dir), tables.supplier_countries(spark, sf_dir)
    return foreign.foreign_recipient(txn, homes, places, **sizes).select(
        "transaction_id", "customer_country", "recipient_country", "is_foreign_recipient"
    )


@query
def foreign_recipient(spark, sf_dir):
    return _foreign(spark, sf_dir)


@query
def foreign_recipient_split(spark, sf_dir):
    """The same with the payments of every larger recipient dealt to several tasks."""
    return _foreign(spark, sf_dir, join_rows=100)


@query
def shift_audit(spark, sf_dir):
    return rounded(audit.shift_audit(_txn(spark, sf_dir)))


@query
def feature_table(spark, sf_dir):
    featured = features.add_features(_txn(spark, sf_dir))
    return rounded(featured.select("customer_id", "transaction_id", *FEATURES, LABEL))


@query
def feature_table_orders(spark, sf_dir):
    """The same on a table where payments tie on customer and time."""
    featured = features.add_features(tables.txn_orders(spark, sf_dir))
    return rounded(featured.select("customer_id", "transaction_id", *FEATURES, LABEL), 4)


@query
def feature_table_split(spark, sf_dir):
    """The same with the history of every customer cut into chunks."""
    featured = features.add_features(_txn(spark, sf_dir), crowded_rows=0, chunk_rows=500)
    return rounded(featured.select("customer_id", "transaction_id", *FEATURES, LABEL), 8)


@query
def feature_table_default_customer(spark, sf_dir):
    """The same on a table without a customer column, so that all rows are one customer's."""
    bare = normalize(ensure_columns(_txn(spark, sf_dir).drop("customer_id")))
    featured = features.add_features(bare)
    # Means over many rows fall on halves of any grid; moved off it, the last bit doesn't decide.
    kinds = dict(featured.dtypes)
    moved = {
        c: F.round(F.col(c) + 3e-5, 3) if c == "time_deviation_from_user_norm" else F.col(c) + 3e-7
        for c in FEATURES
        if kinds[c] == "double"
    }
    featured = featured.withColumns(moved)
    return rounded(featured.select("customer_id", "transaction_id", *FEATURES, LABEL))


# --- accidents put in, and rules that find them ------------------------------------------------


@query
def inject_burst(spark, sf_dir):
    df = inject.inject_bursts(_txn(spark, sf_dir))
    return df.select(
        "customer_id",
        "transaction_id",
        F.unix_micros("timestamp").alias("us"),
        "transaction_type",
        "amount",
        "is_accident_burst",
        "city",
        "entity_type",
        "recipient_entity",
    )


@query
def inject_high_amount(spark, sf_dir):
    df = inject.mark_high_amounts(inject.mark_bursts(_txn(spark, sf_dir)))
    return df.select("transaction_id", "amount", "is_accident_burst", "is_high_amount_accident")


@query
def inject_typo(spark, sf_dir):
    marked = inject.mark_high_amounts(inject.mark_bursts(_txn(spark, sf_dir)))
    return inject.mark_typos(marked).select(
        "transaction_id",
        "recipient_entity",
        "original_recipient_entity",
        "is_mistyped_entity_accident",
    )


@query
def labelled_payments(spark, sf_dir):
    """What the labelling job publishes, read back by its manifest."""
    path = f"{shared_folder(spark).rstrip('/')}/labelled-{uuid.uuid4().hex}"
    publish(label.by_accidents(_txn(spark, sf_dir))["payments"], path, by_day=True)
    return read_published(spark, path).select(
        "transaction_id",
        F.unix_micros("timestamp").alias("us"),
        "amount",
        "recipient_entity",
        "original_recipient_entity",
        *FLAGS,
        LABEL,
    )


@query
def inject_location(spark, sf_dir):
    df = inject.inject_locations(tables.bank_events(spark, sf_dir), BANK_CITIES)
    return df.select("transaction_id", "city", "is_location_anomaly")


@query
def sample_rows(spark, sf_dir):
    return sampling.sample_rows(_txn(spark, sf_dir)).select("transaction_id")


@query
def sticky_attribute(spark, sf_dir):
    return tables.bank_events(spark, sf_dir).select(
        "transaction_id",
        pick(BANK_CITIES, "bank-city", "customer_id").alias("city"),
        phone_number("phone", "customer_id").alias("phone"),
    )


@query
def weighted_pick_query(spark, sf_dir):
    return _txn(spark, sf_dir).select(
        "transaction_id",
        weighted_pick(CITY_POPULATION, "pick-city", "transaction_id").alias("city"),
        weighted_pick(TYPE_WEIGHT, "pick-type", "transaction_id").alias("kind"),
    )


def _bank(spark, sf_dir):
    """The bank table before and after anomalies are put in."""
    bank = tables.bank_events(spark, sf_dir)
    return bank, inject.inject_phones(inject.inject_locations(bank, BANK_CITIES), base=bank)


@query
def phone_mismatch(spark, sf_dir):
    bank = tables.bank_events(spark, sf_dir)
    expected = tables.expected_phones(spark, sf_dir)
    return labels.phone_mismatch(inject.inject_phones(bank), expected, bank).select(
        "transaction_id", "receiver_phone", "expected_phone", "is_phone_mismatch"
    )


@query
def rule_label(spark, sf_dir):
    bank, injected = _bank(spark, sf_dir)
    df = labels.rule_label(injected, tables.expected_phones(spark, sf_dir), 5, bank)
    return df.select(
        "transaction_id",
        "is_high_amount",
        "is_location_anomaly",
        "is_phone_mismatch",
        "is_accident",
    )


@query
def rule_counts(spark, sf_dir):
    bank, injected = _bank(spark, sf_dir)
    expected = tables.expected_phones(spark, sf_dir)
    return labels.rule_counts(labels.rule_label(injected, expected, 2, bank))


@query
def burst_groups(spark, sf_dir):
    groups = labels.burst_groups(_accidents(spark, sf_dir))
    return rounded(
        groups.withColumns(
            {c: F.unix_micros(c) for c in ("started_at", "ended_at")}
        )
    )


@query
def burst_groups_split(spark, sf_dir):
    """The same with the history of every customer cut into chunks."""
    groups = labels.burst_groups(_accidents(spark, sf_dir), crowded_rows=0, chunk_rows=500)
    return rounded(
        groups.withColumns(
            {c: F.unix_micros(c) for c in ("started_at", "ended_at")}
        )
    )


@query
def typo_candidates(spark, sf_dir):
    found = labels.typo_candidates(_accidents(spark, sf_dir))
    return found.withColumns(
        {c: F.unix_micros(c) for c in ("first_seen", "likely_first_seen")}
    )


@query
def edited_accounts(spark, sf_dir):
    found = labels.edited_accounts(_accidents(spark, sf_dir))
    return found.withColumns(
        {c: F.unix_micros(c) for c in ("first_seen", "likely_first_seen")}
    )


# --- evaluation and reports --------------------------------------------------------------------


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_rule_scored(spark, sf_dir))


@query
def classification_report(spark, sf_dir):
    return evaluate.classification_report(_rule_scored(spark, sf_dir))


@query
def recall(spark, sf_dir):
    return evaluate.recall(_rule_scored(spark, sf_dir))


@query
def risk_band_query(spark, sf_dir):
    share = F.round(draw("risk", "transaction_id"), 4)
    txn = _txn(spark, sf_dir).select("transaction_id", share.alias("probability"))
    return txn.withColumn("risk", risk_band("probability"))


@query
def risk_summary(spark, sf_dir):
    return evaluate.risk_summary(_rule_scored(spark, sf_dir))


@query
def flagged_json(spark, sf_dir):
    return evaluate.flagged_json(_rule_scored(spark, sf_dir))


@query
def flagged_report(spark, sf_dir):
    return evaluate.flagged_report(_rule_scored(spark, sf_dir))


# --- model ---------------------------------------------------------------------------------------


@query
def stratified_split(spark, sf_dir):
    labelled = features.target_label(_accidents(spark, sf_dir)).select("transaction_id", LABEL)
    labelled = stage(labelled, "labels")  # read three times
    return sampling.stratified_split(labelled).select("transaction_id", LABEL, "is_test")


@query
def standardize(spark, sf_dir):
    split = split_rows(features.add_features(_accidents(spark, sf_dir)))
    scale = model.fit_scale(split.where(~F.col("is_test")))
    return rounded(scale.apply(split).select("transaction_id", "is_test", *FEATURES), 5)


@query
def one_hot(spark, sf_dir):
    txn = _txn(spark, sf_dir)
    columns = ["transaction_type", "city", "entity_type"]
    encoded = profile.one_hot(txn.select("transaction_id", *columns), columns)
    names = {c: _plain(c) for c in encoded.columns}
    return encoded.withColumnsRenamed(names)


def _plain(name: str) -> str:
    """A column name without blanks and signs."""
    return "".join(ch if ch.isalnum() else "_" for ch in name).lower()


@cache
def _fitted(spark, sf_dir):
    """Model and scored test rows, with the payments they belong to; fitted once per session."""
    txn = stage(_accidents(spark, sf_dir), "accidents")  # read three times
    fitted, scored = train.fit(txn)
    shown = ["transaction_id", *[c for c in txn.columns if c not in (*scored.columns,)]]
    return fitted, scored, scored.join(txn.select(*shown), "transaction_id")


@query
def train_score(spark, sf_dir):
    _, scored, _ = _fitted(spark, sf_dir)
    return scored.select("transaction_id", LABEL, evaluate.PREDICTION, evaluate.PROBABILITY)


@query
def flagged_txn(spark, sf_dir):
    return evaluate.flagged(_fitted(spark, sf_dir)[2])


@query
def validation_view(spark, sf_dir):
    return evaluate.validation_view(_fitted(spark, sf_dir)[2])


@query
def feature_importance(spark, sf_dir):
    fitted, scored, _ = _fitted(spark, sf_dir)
    gain = model.feature_importance(fitted, spark)
    return gain.join(model.permutation_importance(fitted, scored), "feature")


def _saved(spark, fitted):
    """Where a model is saved."""
    path = f"{shared_folder(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    fitted.write().save(path)
    return path


@query
def model_nodes(spark, sf_dir):
    return trees.node_table(spark, _saved(spark, _fitted(spark, sf_dir)[0]))


@query
def row_attribution(spark, sf_dir):
    """What each feature adds to the score of every test row."""
    fitted, scored, _ = _fitted(spark, sf_dir)
    nodes = trees.node_table(spark, _saved(spark, fitted))
    return trees.attribution(nodes, model.scaled(fitted, scored))


@query
def attribution_summary(spark, sf_dir):
    return trees.mean_size(row_attribution(spark, sf_dir))


@query
def model_checks(spark, sf_dir):
    """The validation view scored from the nodes of the saved model, and what holds of each row.

    The probability and the class are those that the model's own classes give, before and after
    loading, what the features add makes up the margin, and the loaded model has the same nodes.
    """
    fitted, scored, shown = _fitted(spark, sf_dir)
    path = _saved(spark, fitted)
    loaded = PipelineModel.load(path)
    nodes, again = (stage(trees.node_table(spark, p), "nodes") for p in (path, _saved(spark, loaded)))
    moved = nodes.exceptAll(again).count() + again.exceptAll(nodes).count()
    rows = stage(model.scaled(loaded, shown.drop(evaluate.PREDICTION, evaluate.PROBABILITY)), "scaled")
    view = trees.score(nodes, rows).select("transaction_id", *evaluate.validation_view(shown).columns)
    ours = view.withColumnsRenamed({evaluate.PREDICTION: "class", evaluate.PROBABILITY: "p"})
    theirs = scored.select("transaction_id", F.col(evaluate.PREDICTION).alias("class_1"), F.col(evaluate.PROBABILITY).alias("p_1"))
    after = model.score(loaded, scored.select("transaction_id", *FEATURES)).select(
        "transaction_id", F.col(evaluate.PREDICTION).alias("class_2"), F.col(evaluate.PROBABILITY).alias("p_2")
    )
    parts = trees.attribution(nodes, rows).select(
        "transaction_id", F.col(trees.MARGIN).alias("m"), sum((F.col(trees.added(c)) for c in FEATURES), F.col(trees.BASE)).alias("m_1")
    )
    same = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-9
    checks = {
        "same_probability": same("p", "p_1") & same("p", "p_2"),
        "same_class": (F.col("class") == F.col("class_1")) & (F.col("class") == F.col("class_2")),
        "parts_add_up": same("m", "m_1") & same("p", "p_3"),
        "same_nodes": F.lit(moved == 0),
    }
    joined = ours.join(theirs, "transaction_id").join(after, "transaction_id").join(
        parts.withColumn("p_3", 1 / (1 + F.exp(-2 * F.col("m")))), "transaction_id"
    )
    return joined.withColumns(checks).select(
        "transaction_id", "customer_id", "amount", "recipient_entity", "city", *FLAGS, LABEL, *checks
    )


@query
def model_roundtrip(spark, sf_dir):
    fitted, scored, _ = _fitted(spark, sf_dir)
    path = _saved(spark, fitted)
    again = model.score(PipelineModel.load(path), scored.select("transaction_id", *FEATURES))
    return again.select("transaction_id", evaluate.PREDICTION, evaluate.PROBABILITY)


for _long, _short in [
    ("ensure_columns_query", "ensure_columns"),
    ("step_to_timestamp_query", "step_to_timestamp"),
    ("normalize_phone_query", "normalize_phone"),
    ("weighted_pick_query", "weighted_pick"),
    ("risk_band_query", "risk_band"),
]:
    QUERIES[_short] = QUERIES.pop(_long)
