import hashlib
import random
import re

import numpy as np
from corpus import edge_rows, edited, prose, shingles, table

from slotwise.llm import dedup, jaccard
from slotwise.llm.components import components


def _expected_dedup(rows):
    groups = {}
    for i, text in rows:
        digest = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()
        groups.setdefault(digest, []).append((-len(text or ""), i is None, i or 0, i))
    return sorted(
        (repr(i), min(g)[3], len(g), i == min(g)[3], d) for d, g in groups.items() for _, _, _, i in g
    )


def test_dedup_matches_brute_force_on_odd_rows(spark):
    rows = edge_rows()
    got = dedup.dedup(table(spark, rows), dedup.fresh_index(spark)).collect()
    assert sorted((repr(r.doc_id), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == _expected_dedup(rows)


def test_index_keeps_what_earlier_batches_brought(spark):
    index = dedup.fresh_index(spark)
    dedup.dedup(table(spark, [(5, "a b"), (6, "c")]), index).collect()
    got = {r.doc_id: r for r in dedup.dedup(table(spark, [(1, "ab"), (2, "d"), (3, "d  ")]), index).collect()}
    assert got[1].keep_id == 5 and not got[1].kept
    assert got[3].kept and got[2].keep_id == 3
    assert index.rows().count() == 3
    again = dedup.DigestIndex(spark, index.table)
    assert again.rows().count() == 3
    index.drop()


def test_dedup_of_nothing(spark):
    assert dedup.dedup(table(spark, []), dedup.fresh_index(spark)).collect() == []


def test_dedup_plan_has_no_python(spark):
    df = dedup.dedup(table(spark, edge_rows()), dedup.fresh_index(spark))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def _components(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    members = {}
    for a in range(len(sets)):
        members.setdefault(find(a), []).append(sets[a][0])
    least = {r: min((i for i in m if i is not None), default=None) for r, m in members.items()}
    return sorted(
        (repr(i), len(s), least[find(a)] if s else i) for a, (i, s) in enumerate(sets)
    )


def _near_copies():
    """Groups whose members are near each other by steps, so that links make chains."""
    rows, rng = [], random.Random(8)
    for g in range(4):
        text = prose(1000 + g, 150 + 40 * g)
        for k in range(20):
            rows.append((1000 * (g + 1) + k, text))
            text = edited(text, 50 * g + k, rng.randint(0, 3))
    return rows


def test_jaccard_matches_brute_force(spark):
    rows = edge_rows() + _near_copies()
    for n, percent in ((3, 90), (5, 80)):
        got = jaccard.jaccard_components(table(spark, rows), jaccard.Rule(n, percent)).collect()
        assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in got) == _components(rows, n, percent)


def test_jaccard_in_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "ROWS_PER_BIN", 50)
    rows = _near_copies()
    got = jaccard.jaccard_components(table(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in got) == _components(rows, 3, 90)


def _sets(seed):
    """Sets of numbers of all sizes, some nearly alike, some of another level, two empty."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(base[: rng.integers(1, 400)]) for _ in range(20)] + [base[:0]] * 2
    for cut in (300, 9000, 20000):
        for gone in (0, 1, cut // 30, cut // 10):
            sets.append(np.unique(np.concatenate([base[gone:cut], rng.integers(0, 1 << 63, gone // 2, dtype=np.uint64)])))
    return sets


def test_products_match_sets(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 100)
    monkeypatch.setattr(jaccard, "ENTRIES", 5000)
    sets = _sets(3)
    told = [set(x.tolist()) for x in sets]
    sizes = np.array([len(x) for x in sets])
    a, b = np.triu_indices(len(sets), 1)
    for rule in (jaccard.Rule(3, 90), jaccard.Rule(5, 80)):
        whole = jaccard.Incidence.of(sizes, [x.tobytes() for x in sets], np.uint64)
        linked = np.array([100 * len(told[x] & told[y]) >= rule.percent * len(told[x] | told[y]) for x, y in zip(a, b, strict=True)])
        assert (jaccard.pairs_in_reach(whole, a, b, rule) == linked).all()
        every = np.arange(len(sets))
        assert jaccard.product(whole, every, every).tolist() == [[len(x & y) for y in told] for x in told]
        first = jaccard.Incidence.of(sizes, [jaccard.first_block(x) for x in sets], np.uint32)
        near = np.zeros(len(a), bool)
        for some, cut in jaccard.by_level(first, a, b):
            near[some] = jaccard.pairs_in_reach(cut, a[some], b[some], rule)
        assert near[linked].all()
        filled = np.flatnonzero(sizes)
        long = jaccard._long_pairs(filled, filled, False, every, first, rule, False)
        both = linked & (sizes[a] > 0) & (sizes[b] > 0)
        assert set(zip(a[both], b[both], strict=True)) <= {tuple(x) for x in long.tolist()}


def test_first_block_tells_unrelated_sets_apart():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in (300, 310, 320, 9000, 9100)]
    first = jaccard.Incidence.of(np.array([len(x) for x in sets]), [jaccard.first_block(x) for x in sets], np.uint32)
    assert first.ends[-1] < sum(len(x) for x in sets) / 4  # a quarter, an eighth of the large ones
    a, b = np.triu_indices(len(sets), 1)
    for some, cut in jaccard.by_level(first, a, b):
        assert not jaccard.pairs_in_reach(cut, a[some], b[some], jaccard.Rule(3, 90)).any()


def test_jaccard_in_long_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", 3)
    monkeypatch.setattr(jaccard, "PAIRS_PER_BIN", 5)
    rows = _near_copies()
    got = jaccard.jaccard_components(table(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in got) == _components(rows, 3, 90)


def test_a_group_of_near_copies_makes_no_row_per_pair(spark, monkeypatch):
    rows_of, write = {}, jaccard.written

    def counted(df, label):
        table = write(df, label)
        rows_of[label] = max(rows_of.get(label, 0), table.count())
        return table

    monkeypatch.setattr(jaccard, "written", counted)
    text = prose(5, 150)
    rows = [(i, edited(text, i, 4 if i % 3 else 1)) for i in range(160)]
    got = jaccard.jaccard_components(table(spark, rows, clash=False)).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in got) == _components(rows, 3, 90)
    assert max(rows_of.values()) <= rows_of["found"], rows_of  # a row per member of a list; the pairs are five times as many


def test_jaccard_of_nothing_and_of_empty_texts(spark):
    assert jaccard.jaccard_components(table(spark, [])).collect() == []
    got = jaccard.jaccard_components(table(spark, [(1, None), (2, ""), (3, " ")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {}
    for r in components(spark.createDataFrame(links, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(41)), list(range(100, 140))]
