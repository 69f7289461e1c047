import hashlib
from fractions import Fraction

import pytest
from corpus import prose, table, words
from pyspark.sql import functions as F

from slotwise.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def water_filled(sizes: dict, weights=(5, 2, 1), epochs=3) -> dict:
    """Targets by the plain loop: clamp, share the excess anew, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped = set()
    while True:
        rest = sum(sizes.values()) - sum(epochs * sizes[s] for s in clamped)
        free = [s for s in order if s not in clamped]
        target = {s: Fraction(epochs * sizes[s]) for s in clamped}
        target |= {s: Fraction(rest * weight[s], sum(weight[f] for f in free)) for s in free}
        above = [s for s in free if target[s] > epochs * sizes[s]]
        if not above:
            return target
        clamped.update(above)


def expected(rows, **how):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    out = []
    for source, target in water_filled(sizes, **how).items():
        own = [(d, t) for d, t, s in rows if s == source]
        own.sort(key=lambda r: hashlib.md5(f"13:{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest())
        whole, left = divmod(int(target + Fraction(1, 2)), sizes[source]) if sizes[source] else (0, 0)
        for doc_id, text in own:
            n = len(words(text))
            out.append((doc_id, source, n, sizes[source], float(target), whole * n + min(n, left)))
            left -= min(n, left)
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def close(a, b):
    return len(a) == len(b) and all(x[:4] + x[5:] == y[:4] + y[5:] and x[4] == pytest.approx(y[4], rel=1e-12) for x, y in zip(a, b))


def test_targets_and_taken_words_match_a_plain_loop(spark):
    rows = [(i, prose(i, 3 + i % 40), f"s{i % 7}") for i in range(300)]
    rows += [(1000 + i, prose(i, 5), "A") for i in range(3)]  # a small source of weight 5 is clamped
    rows += [(2000 + i, prose(i, 9), "é") for i in range(4)] + [(3000, None, "no words"), (3001, " \t\n", "no words")]
    rows += [(None, prose(4, 9), None), (None, prose(5, 30), None), (7, prose(7, 20000), "one long"), (8, "", None)]
    got = mixing.mixed(table(spark, rows, SCHEMA))
    assert close(found(got), expected(rows))
    assert close(found(mixing.mixed(table(spark, rows, SCHEMA).repartition(5))), expected(rows))
    by_source = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.5 for r in by_source)
    assert got.filter("taken > 3 * size").isEmpty()


def test_equal_rows_share_one_place_in_the_order(spark):
    """A third of all rows are one row; the cut falls among them."""
    rows = [(5, "same few words", "a")] * 400 + [(i, prose(i, 30), "b") for i in range(60)] + [(i, prose(i, 2), "c") for i in range(9)]
    want = expected(rows)
    assert len({r[5] for r in want if r[1] == "a"}) > 1
    for parts in (1, 7):
        assert close(found(mixing.mixed(table(spark, rows, SCHEMA).repartition(parts))), want)


def test_other_weights_and_epochs(spark):
    rows = [(i, prose(i, 4 + i % 11), f"h{i % 90:03d}") for i in range(270)]
    assert close(found(mixing.mixed(table(spark, rows, SCHEMA), weights=(100, 1), epochs=2)), expected(rows, weights=(100, 1), epochs=2))
    assert close(found(mixing.mixed(table(spark, rows, SCHEMA), weights=(1,), epochs=1)), expected(rows, weights=(1,), epochs=1))


def test_tables_without_rows_or_words(spark):
    assert mixing.mixed(table(spark, [], SCHEMA)).collect() == []
    rows = [(1, None, None), (2, "", "a"), (2, "", "a")]
    assert found(mixing.mixed(table(spark, rows, SCHEMA))) == sorted([(1, None, 0, 0, 0.0, 0)] + [(2, "a", 0, 0, 0.0, 0)] * 2, key=repr)
