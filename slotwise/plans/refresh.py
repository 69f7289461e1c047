"""The batch refresh: run catalogue analyses and store each result."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession

from slotwise.plans.catalogue import BY_NAME, run
from slotwise.sources.results import ResultStore
from slotwise.sources.tables import Tables


PLANS = 2  # raised whenever an analysis changes its result


def refresh(
    spark: SparkSession,
    t: Tables,
    store: ResultStore,
    edition: str,
    names: Iterable[str] | None = None,
    params: Mapping[str, Mapping] | None = None,
) -> list[str]:
    """Store each result as view ``result_<name>``; results already stored are kept.

    The fingerprint holds name, parameters, the tables' source and network, the version
    of the plans and ``edition`` (such as the refresh date), so that a result made from
    anything else is made anew.
    """
    done = []
    for name in names or BY_NAME:
        own = dict((params or {}).get(name, {}))
        text = f"{name} {sorted(own.items(), key=str)!r} of {t.source!r} on {t.network} by plans {PLANS} @ {edition}"
        store.result_view(f"result.{name}", text, lambda n=name, p=own: run(n, t, spark, **p))
        done.append(name)
    return done
