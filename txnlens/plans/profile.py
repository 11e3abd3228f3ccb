"""Write the profile of a payment table: ``spark-submit txnlens/plans/profile.py IN OUT``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from txnlens.operators import profile
from txnlens.session import job_session
from txnlens.sources.csv import write_csv
from txnlens.sources.files import add_input_options, load


def reports(txn: DataFrame) -> dict[str, DataFrame]:
    """The profile's tables by name; all of them are small."""
    found = {
        "null_profile": profile.null_profile(txn),
        "txn_per_day": profile.txn_per_day(txn),
        "txn_per_week": profile.txn_per_week(txn),
        "top_customers": profile.top_customers(txn),
        "top_recipients": profile.top_values(txn, "recipient_entity", 5),
        "flag_distribution": profile.flag_distribution(txn),
        "accident_totals": profile.accident_totals(txn),
        "amount_summary": profile.number_summary(txn),
    }
    if "entity_type" in txn.columns:
        found["top_entity_types"] = profile.top_entity_types(txn)
    return found


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("input")
    parser.add_argument("output")
    add_input_options(parser)
    args = parser.parse_args()
    spark = job_session("txnlens-profile")
    txn = load(spark, args.input, args.format, not args.lenient, args.timestamp_format)
    for name, report in reports(txn).items():
        write_csv(report, f"{args.output.rstrip('/')}/{name}", mode="overwrite")


if __name__ == "__main__":
    main()
